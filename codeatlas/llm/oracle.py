"""DuckDB SQL of the queries that SQL can express, over the given tables."""

from __future__ import annotations

from .quality_rules import HALF, MAX_REPEAT_PERCENT, MIN_GROUP, MIN_WORDS, REACH, STATISTICS, TAIL

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"

EXACT_DEDUP = rf"""
WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS sha FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha AS text_sha256
FROM h WINDOW g AS (PARTITION BY sha)
"""

MIX = rf"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, (sum(source_size) OVER ())::BIGINT AS total FROM src),
levels AS (SELECT *,
    total - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
    sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM weighed),
filled AS (SELECT *, w * rest >= 3 * source_size * rest_w AS filled FROM levels),
targets AS (SELECT source, source_size,
    CASE WHEN filled THEN (3 * source_size)::DOUBLE ELSE w * (max(CASE WHEN NOT filled THEN rest END) OVER ())::DOUBLE / max(CASE WHEN NOT filled THEN rest_w END) OVER () END AS target,
    ('0x' || substr(sha256('mix-1:' || coalesce(source, chr(0))), 1, 4))::INTEGER / 65536.0::DOUBLE AS u FROM filled),
placed AS (SELECT s.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS j FROM s),
rated AS (SELECT p.doc_id, p.size, p.j, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS r
    FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source),
taken AS (SELECT *, (floor((j + 1)::DOUBLE * r + u) - floor(j::DOUBLE * r + u))::BIGINT AS copies FROM rated)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken
"""

_SHARES = {"word_length": "100 * word_chars // n_words", "symbol_share": "1000 * n_symbols // word_chars", "dup_line_share": "1000 * n_dup_lines // n_lines",
           "repeat_share": "1000 * n_repeat_words // n_words", "capital_share": "1000 * n_capitals // word_chars"}
_DIVISORS = {"word_length": "n_words", "symbol_share": "word_chars", "dup_line_share": "n_lines", "repeat_share": "n_words", "capital_share": "word_chars"}
_STATS = ", ".join(f"CASE WHEN {_DIVISORS[s]} > 0 THEN {_SHARES[s]} ELSE 0 END AS s_{s}" for s in STATISTICS)
_LONG = " UNION ALL ".join(f"SELECT lang, source, '{s}' AS statistic, s_{s} AS v FROM passed" for s in STATISTICS)
_SLACK = "CASE statistic " + " ".join(f"WHEN '{s}' THEN {v}" for s, (v, _) in STATISTICS.items()) + " END"
_KINDS = ("lo", "hi", "own_lo", "own_hi", "half_lo", "half_hi")
_WIDE = ", ".join(f"max(CASE WHEN statistic = '{s}' THEN {k} END) AS {k}_{s}" for s in STATISTICS for k in _KINDS)
_NEAR = ", ".join(f"CASE WHEN o.total >= {MIN_GROUP} THEN o.{k}_{s} WHEN l.total >= {MIN_GROUP} THEN l.{k}_{s} ELSE a.{k}_{s} END AS {k}_{s}" for s in STATISTICS for k in _KINDS[:4])
_ALL = ", ".join(f"a.{k}_{s}" for s in STATISTICS for k in _KINDS[4:])
_PICK = ", ".join(f"greatest(lo_{s}, least(own_lo_{s}, half_lo_{s})) AS lo_{s}, least(hi_{s}, greatest(own_hi_{s}, half_hi_{s})) AS hi_{s}" for s in STATISTICS)
_AT = ", ".join(f"min(CASE WHEN 100 * upto >= {p} * total THEN bucket END) AS {k}" for k, p in (("p10", 10), ("q1", 25), ("q2", 50), ("q3", 75), ("p90", 90)))
_BEYOND = " OR ".join(f"s_{s} > hi_{s}" + (f" OR s_{s} < lo_{s}" if both else "") for s, (_, both) in STATISTICS.items())

QUALITY = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    [l for l in string_split(coalesce(text, ''), chr(10)) if regexp_matches(l, '{WORD}')] AS lines FROM documents),
wins AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
base AS (SELECT t.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(x, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(x, '[^A-Z!]+', '', 'g'))::BIGINT AS n_capitals,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM t LEFT JOIN cover ON t.doc_id = cover.doc_id),
measured AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {_STATS} FROM base),
passed AS (SELECT * FROM measured WHERE NOT base_failed),
buckets AS (SELECT lang, source, statistic, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bucket FROM ({_LONG})),
sketch AS (SELECT 2 AS level, lang, source, statistic, bucket, count(*) AS n FROM buckets GROUP BY ALL
    UNION ALL SELECT 1, lang, NULL, statistic, bucket, count(*) FROM buckets GROUP BY ALL
    UNION ALL SELECT 0, NULL, NULL, statistic, bucket, count(*) FROM buckets GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, statistic ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, statistic) AS total FROM sketch),
quantiles AS (SELECT level, lang, source, statistic, max(total) AS total, {_AT}, {_SLACK} AS slack FROM ranked GROUP BY level, lang, source, statistic),
reach AS (SELECT *, q1 - {REACH} * (q3 - q1) AS low, q3 + {REACH} * (q3 - q1) AS high FROM quantiles),
fences AS (SELECT *, low - slack AS lo, high + slack AS hi, q3 - {TAIL} * (p90 - q3) - slack AS own_lo, q1 + {TAIL} * (q1 - p10) + slack AS own_hi,
    greatest(low, q2 - {HALF} * (q3 - q2)) - slack AS half_lo, least(high, q2 + {HALF} * (q2 - q1)) + slack AS half_hi FROM reach),
wide AS (SELECT level, lang, source, max(total) AS total, {_WIDE} FROM fences GROUP BY level, lang, source),
near AS (SELECT o.lang, o.source, {_NEAR}, {_ALL} FROM wide o JOIN wide l ON l.level = 1 AND o.lang IS NOT DISTINCT FROM l.lang JOIN wide a ON a.level = 0 WHERE o.level = 2),
picked AS (SELECT lang, source, {_PICK} FROM near)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    CASE WHEN base_failed THEN FALSE ELSE NOT coalesce({_BEYOND}, FALSE) END AS kept
FROM measured m LEFT JOIN picked p ON m.lang IS NOT DISTINCT FROM p.lang AND m.source IS NOT DISTINCT FROM p.source
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS k FROM d WHERE n >= 50)),
gone AS (SELECT doc_id, k FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
bytes AS (SELECT doc_id, k, substr(h, 2 * k + 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(0, n)) AS k FROM d)),
last AS (SELECT b.doc_id, b.k, b.b, max(g.k) OVER (PARTITION BY b.doc_id ORDER BY b.k) AS start FROM bytes b LEFT JOIN gone g ON b.doc_id = g.doc_id AND b.k = g.k),
marked AS (SELECT *, coalesce(k - start < 50, FALSE) AS off FROM last),
runs AS (SELECT *, off AND NOT coalesce(lag(off) OVER (PARTITION BY doc_id ORDER BY k), FALSE) AS begins FROM marked),
cut AS (SELECT doc_id, count(*) FILTER (off) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(b, '' ORDER BY k) FILTER (NOT off) AS kept FROM runs GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
"""

ORACLE = {"op1_quality_rules": QUALITY, "op3_mix_sources": MIX, "op7_exact_dedup": EXACT_DEDUP, "op10_suffix_dedup": SUFFIX_DEDUP}

# -- centroid clustering: rounds are unrolled ------------------------------------------------------------------------
_ROUND = """
a{k} AS MATERIALIZED (SELECT vec_id, x, c, d FROM (SELECT v.vec_id, v.x, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d,
    row_number() OVER (PARTITION BY v.vec_id ORDER BY d, c.c) AS place FROM v CROSS JOIN c{k} c) WHERE place = 1),
c{n} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM (
    SELECT c, j, sum(x[j])::BIGINT AS s, count(*)::BIGINT AS n FROM a{k}, range(1, 65) AS r(j) GROUP BY c, j) GROUP BY c) m ON c.c = m.c)"""
CENTROIDS = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS c, x FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8),""" + ",".join(
    _ROUND.format(k=k, n=k + 1) for k in range(11)) + """
SELECT a.vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a10 a JOIN c10 c ON a.c = c.c
"""

_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, w, least(10, len(w)) AS t FROM (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS MATERIALIZED (SELECT DISTINCT item, t, array_to_string(w[k:k + t - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - t + 2)) AS k FROM i)),
word AS MATERIALIZED (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
dw AS (SELECT doc_id, k, t, string_agg(x, ' ') OVER (PARTITION BY doc_id, t ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM word, (SELECT DISTINCT t FROM iw)),
found AS MATERIALIZED (SELECT dw.doc_id, dw.k, dw.t, iw.item FROM dw JOIN iw ON dw.t = iw.t AND array_to_string(string_split(dw.ten, ' ')[1:dw.t], ' ') = iw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + t)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id),
run AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM (SELECT DISTINCT doc_id, unnest(range(k, k + t)) AS p FROM found)) WHERE q IS NULL OR p > q + 1 GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(hit.n, 0) > 0 AS contaminated, coalesce(run.n, 0)::BIGINT AS n_spans
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id LEFT JOIN run ON d.doc_id = run.doc_id
"""

_ORDERS = "SELECT " + " || ".join(f"s{k}.f" for k in range(5)) + " AS o FROM " + ", ".join(f"f AS s{k}" for k in range(5)) + " WHERE " + " AND ".join(
    f"s{j}.f <> s{k}.f" for k in range(5) for j in range(k))
FILTER_AUDIT = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
failed AS (SELECT part, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 5 * length(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END AS fails,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND toxic = 1) AS toxic FROM t),
n AS MATERIALIZED (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), orders AS ({_ORDERS}),
steps AS (SELECT part, fails, n, good, toxic, o, step, o[step] AS f, contains(fails, o[step]) AS fails_it,
    EXISTS (SELECT 1 FROM f WHERE contains(fails, f.f) AND contains(o[1:step - 1], f.f)) AS before FROM n, orders, range(1, 6) AS r(step)),
counted AS (SELECT part, o AS filter_order, step::INTEGER AS step, f AS filter, coalesce(sum(n) FILTER (NOT fails_it AND NOT before), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails_it AND NOT before), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails_it AND before), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails_it AND NOT before), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fails_it AND NOT before), 0)::BIGINT AS toxic_lost FROM steps GROUP BY part, o, step, f)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counted
"""

ORACLE |= {"op11_centroid_clusters": CENTROIDS, "op12_benchmark_decontamination": DECONTAMINATION, "op13_filter_audit": FILTER_AUDIT}
