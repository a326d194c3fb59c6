"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeatlas.llm.exact_dedup import exact_dedup, keep_one
from codeatlas.llm.licenses import scan
from codeatlas.llm.mixing import emit, mixed_counts
from codeatlas.llm.oracle import QUALITY
from codeatlas.llm.packing import pack
from codeatlas.llm.quality_ranker import classify
from codeatlas.llm.quality_rules import keep_good, quality_report
from codeatlas.llm.simhash import keep_first, near_groups
from codeatlas.llm.suffix_dedup import suffix_dedup
from codeatlas.llm.token_files import round_trip
from codeatlas.llm.toxicity import classify_toxic

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977} z{k}" for k in range(20_000))
WORDS = " ".join(f"alpha{k} beta{k}" for k in range(40))
ROWS = [
    (1, WORDS, "en", "a", 1), (2, WORDS.replace(" ", "\n"), "en", "a", 1), (3, WORDS, "en", "b", 1), (3, WORDS, "en", "b", 1),
    (4, None, "en", "b", None), (5, "", None, None, 0), (6, " \n\t ", "de", "c", 4), (7, LONG, "de", "c", len(LONG)),
    (None, "lonely words here", "fr", "c", 17), (None, WORDS + " end", None, "a", 5), (8, "Été MIT\nLicense MIT license", "fr", None, 9),
    (9, WORDS + " tail", "en", "a", 2), (10, "x " * 300, "en", "a", 600),
]
CLASH = ("kept", "size", "target", "first", "offset", "rank", "word", "bits", "part", "score", "fp", "n")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k > 7)) for k in range(11)] + [(None, 1, None), (4, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_rules(docs, none):
    got = [r.asDict() for r in quality_report(docs).collect()]
    assert len(got) == len(ROWS)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[4][0]["n_words"] == by[5][0]["n_words"] == by[6][0]["n_words"] == 0
    assert by[4][0]["base_failed"] and not by[4][0]["kept"]
    assert by[7][0]["n_words"] == 40_000 and by[7][0]["n_repeat_words"] == 0
    assert by[10][0]["n_repeat_words"] == 300 and by[10][0]["base_failed"]
    assert by[3][0] == by[3][1] and by[1][0]["kept"]
    assert quality_report(none).count() == 0
    kept = keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, 9}
    assert keep_good(none).count() == 0


def test_quality_rules_many_repeats(spark):
    """Texts with many different repeated windows take the sorting branch; both branches agree with brute force."""
    texts = [" ".join(f"p{k % m} q{k % (m + 1)}" for k in range(n)) for m in (3, 30, 90) for n in (5, 200, 900)] + ["a a a a", "a b", ""]
    got = {r.doc_id: r.n_repeat_words for r in quality_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("x"), "source": F.lit("y")})).collect()}
    for k, t in enumerate(texts):
        w = words(t)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        assert got[k] == len({j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}), k


@pytest.mark.parametrize("share", [30, 60, 80])
@pytest.mark.parametrize("kind", ["symbols", "capitals", "repeats", "lines"])
def test_quality_rules_of_a_junk_heavy_source(spark, kind, share):
    """A source with a third of all rows, mostly junk, loses it, up to three quarters; an unusual clean source and the others
    stay. The query's SQL agrees at any share."""
    def text(k, junk, marks=0):
        w = [f"word{k % 97}x{j} other{j * 7 % 1000 + k % 13}" for j in range(45)]
        if junk == "symbols":
            w = [f"{x} {'#$%|' * 2}" for x in w]
        elif junk == "capitals":
            w = [x.upper() for x in w]
        elif junk == "repeats":
            w += ["the same three words"] * 20
        elif junk == "lines":
            return "\n".join(w[:15] + ["again"] * 17 + [" ".join(w[15:])])
        return " ".join(w) + " #" * marks

    rows = []
    for k in range(400):
        rows.append((k, text(k, kind if k % 100 < share else None), "en", "hot", "junk" if k % 100 < share else "clean"))
        rows.append((1000 + k, text(k, None), "en", f"s{k % 2}", "clean"))
        rows.append((2000 + k, text(k, None, 20 + k % 30), "en", "unusual", "clean") if k % 2 else (2000 + k, text(k, None), "en", "s2", "clean"))
    df = spark.createDataFrame([(i, t, la, so) for i, t, la, so, _ in rows], "doc_id long, text string, lang string, source string")
    got, what = {r.doc_id: r for r in quality_report(df).collect()}, {r[0]: r[4] for r in rows}
    if share <= 75:
        assert all(got[i].kept for i in what if what[i] == "clean")
        assert not any(got[i].kept for i in what if what[i] == "junk")
    sql = duckdb.connect()
    sql.register("documents", df.toPandas())
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted(sql.execute(f"SELECT {', '.join(columns)} FROM ({QUALITY})").fetchall()) == sorted(tuple(r[c] for c in columns) for r in got.values())


def test_stages_carry_columns_with_helpers_names(spark):
    """Columns named like the stages' own helpers come through unchanged."""
    names = ["__w", "__sha", "__size", "__copy", "__lang", "__first", "__kept", "__source", "carried0", "__N"]
    docs = spark.createDataFrame([(k, " ".join(f"a{k}b{j}" for j in range(60 + k)), "en", "s") for k in range(12)], "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    for stage in (keep_good, keep_one, keep_first, emit):
        kept = stage(docs)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_exact_dedup(docs, none):
    got = [r.asDict() for r in exact_dedup(docs).collect()]
    assert len(got) == len(ROWS)
    same = defaultdict(list)
    for i, t, *_ in ROWS:
        same[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = Counter()
    for t, ids in same.items():
        least = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, least, len(ids), i == least, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    kept = keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(same)
    assert exact_dedup(none).count() == keep_one(none).count() == 0


def test_repeated_row_leaves_one(spark):
    df = spark.createDataFrame([(5, "same text")] * 4 + [(6, "same  text")], "doc_id long, text string")
    assert [r.doc_id for r in keep_one(df).collect()] == [5]


def test_mixing(docs, none):
    got = mixed_counts(docs).collect()
    assert len(got) == len(ROWS)
    size = Counter()
    for _, t, _, s, _ in ROWS:
        size[s] += len(words(t))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(words(t))) for i, t, *_ in ROWS)
    assert sum(size.values()) == pytest.approx(sum({r.source_size: r.target for r in got}.values()))
    assert all(r.target <= 3 * r.source_size and r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    assert sorted(got, key=str) == sorted(mixed_counts(docs.repartition(5)).collect(), key=str)
    out = emit(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixed_counts(none).count() == emit(none).count() == 0


def test_mixing_near_targets(spark):
    rows = [(k, "w " * (1 + k % 50), f"s{k % 7}" if k % 3 else "hot") for k in range(5000)]
    got = mixed_counts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {k: s for k, _, s in rows}
    taken, target = Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 50 for s, t in target.items())


def test_packing(docs, none):
    got = pack(docs).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ROWS}
    spans = defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(spans) == -(-sum(r.length for r in got) // 2048)
    assert pack(none).count() == 0


def test_classifiers(docs, labels, none):
    got = classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert classify(none, labels).count() == 0
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}
    got = classify_toxic(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.is_toxic == (r.predicted == 1) for r in got)
    assert classify_toxic(none, labels).count() == 0
    assert len(classify_toxic(docs, labels.limit(0)).collect()) == len(ROWS)


def test_licenses(docs, none):
    got = scan(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert (by[8].n_base, by[8].first_word, by[8].last_word, by[8].base_labels, by[8].n_words) == (2, 1, 3, "mit", 5)
    assert (by[4].n_words, by[4].first_word, by[4].labels, by[4].score) == (0, None, "", 0.0)
    assert scan(none).count() == 0


def test_simhash(docs, none):
    got = near_groups(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[4].fingerprint == "0" * 16 and by[4].component_id == by[5].component_id == by[6].component_id == 4
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert near_groups(none).count() == keep_first(none).count() == 0


def test_keep_first_leaves_one_of_each_group(spark):
    def text(k, end=""):
        return " ".join(f"g{k}w{j}x{j * k % 13}" for j in range(200)) + end

    rows = [(None, text(1)), (None, text(1).upper()), (None, text(1)),                 # null ids alone, one row twice
            (None, text(2)), (5, text(2).upper()),                                     # a null id and another
            (7, text(3)), (7, text(3).upper()), (8, text(3).replace(" ", "  ")),       # an id with two texts of a group
            (9, text(4)), (9, text(5)), (6, text(5).upper()), (10, None), (None, "")]  # an id in two groups
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for radius in (0, 2):
        kept = [(r.doc_id, r.text) for r in keep_first(df, radius=radius).collect()]
        assert sorted(str(t or "").lower().split()[:1] for _, t in kept) == [[], *([f"g{k}w0x0"] for k in (1, 2, 3, 4, 5))]
        assert Counter(k for k, _ in kept) == Counter([None, 5, 7, 9, 6, 10])
        assert min((t for k, t in rows if k == 7), key=lambda t: hashlib.sha256(t.encode()).hexdigest()) in [t for k, t in kept if k == 7]


def test_token_files(docs, none):
    got = sorted(round_trip(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert round_trip(none).count() == 0


def test_suffix_dedup(docs, none):
    got = suffix_dedup(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert (by[4].n_bytes, by[4].n_removed, by[1].n_removed) == (0, 0, 0)
    assert by[3].n_removed == by[3].n_bytes and by[3].n_spans == 1 and by[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert suffix_dedup(none).count() == 0


def test_stages(spark, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "").cache()
        assert now.count() > 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
