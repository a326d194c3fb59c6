import datetime

import pytest
from pyspark.sql import functions as F

from codeatlas.operators import docs as D
from codeatlas.operators import maintain as M
from codeatlas.operators import search as S
from codeatlas.functions.score import fuzzy_threshold, near, score_match
from codeatlas.operators.search_index import SearchIndex, asked_keys, keys_of
from codeatlas.sources import markdown
from tests.helpers import T0, T1, docs_of, ts_tables


def _docs(spark):
    return docs_of(spark, [
        ("ts", 1, "roundTo", "src/money.ts", "function", "Rounds a price to whole coins.", ["coins"], "manual", T0, T1),
        ("ts", 2, "Cart", "src/index.ts", "class", "Holds users.", None, "auto", T0, T0),
        ("ts", 3, "gone", "src/old.ts", "function", "Removed thing.", None, "manual", T0, T0),
        ("ts", 4, "Guide", "", "page", "A free page.", None, None, T0, T0),
    ])


def test_coverage_two_of_six(spark):
    files, el, _ = ts_tables(spark)
    r = D.doc_coverage(el, _docs(spark)).collect()[0]
    assert (r.total, r.covered, r.percent) == (6, 2, 33)
    assert D.undocumented(el, _docs(spark)).count() == 4


def test_coverage_without_api_is_100(spark):
    el = spark.createDataFrame([("p", "a.ts", 1, "a.ts:x", "x", "variable", 1, None, None, False)],
                               "project string, path string, elem_ord long, id string, name string, type string, line int, "
                               "signature string, doc_comment string, exported boolean")
    assert D.doc_coverage(el, _docs(spark)).collect()[0].percent == 100


def test_stale(spark):
    files, el, _ = ts_tables(spark)
    mt = spark.createDataFrame([("ts", "src/money.ts", datetime.datetime(2024, 3, 1)),
                                ("ts", "src/index.ts", datetime.datetime(2024, 3, 1))], "project string, path string, mtime timestamp")
    got = {(r.element, r.status) for r in D.doc_stale(files, el, _docs(spark), mt).collect()}
    assert got == {("gone", "orphaned"), ("Cart", "outdated")}


def test_doc_lookup_alias_and_show(spark):
    names = spark.createDataFrame([("ts", "coins"), ("ts", "nope")], "project string, name string")
    r = D.doc_lookup(_docs(spark), names).collect()
    assert [(x.name, x.element) for x in r] == [("coins", "roundTo")]


def test_upsert_keeps_created_drops_aliases(spark):
    files, el, _ = ts_tables(spark)
    ch = spark.createDataFrame([("ts", 1, "roundTo", "New text"), ("ts", 2, "x.rs", "rust"), ("ts", 3, "y", "")],
                               "project string, change_ord long, element string, content string")
    nd, st = M.doc_add(files, el, _docs(spark), ch, now=datetime.datetime(2025, 1, 1))
    fg = nd.where("element = 'roundTo'").collect()[0]
    assert (fg.content, fg.created_at, fg.aliases, fg.source) == ("New text", T0, None, None)
    rs = nd.where("element = 'x.rs'").collect()[0]
    assert (rs.type, rs.path) == ("file", "x.rs")
    assert [r.status for r in st.orderBy("change_ord").collect()] == ["updated", "added", "content_required"]


def test_create_page_resets_created(spark):
    ch = spark.createDataFrame([("ts", 1, "Guide", None)], "project string, change_ord long, name string, content string")
    nd, _ = M.doc_create(_docs(spark), ch, now=datetime.datetime(2025, 1, 1))
    g = nd.where("element = 'Guide'").collect()[0]
    assert g.created_at == datetime.datetime(2025, 1, 1) and g.content.startswith("# Guide")


def test_save_keeps_aliases(spark):
    ch = spark.createDataFrame([("ts", 1, "roundTo", "edited"), ("ts", 2, "Fresh", "new page")],
                               "project string, change_ord long, element string, content string")
    nd, _ = M.doc_save(_docs(spark), ch, now=datetime.datetime(2025, 1, 1))
    fg = nd.where("element = 'roundTo'").collect()[0]
    assert (fg.content, fg.aliases, fg.source) == ("edited", ["coins"], "manual")
    assert "**Path:** src/money.ts" in fg.markdown
    assert nd.where("element = 'Fresh' and type = 'page' and path = ''").count() == 1


def test_seed_rules(spark):
    el = spark.createDataFrame([
        ("p", "a.py", 1, "a.py:f", "f", "function", 1, "f()", "doc f", True),
        ("p", "b.py", 1, "b.py:f", "f", "function", 1, "f()", "doc f", True),
        ("p", "c.py", 1, "c.py:f", "f", "function", 1, "f()", "doc f2", True),
        ("p", "a.py", 2, "a.py:g", "g", "function", 5, "g()", "doc g", True),
        ("p", "a.py", 3, "a.py:h", "h", "function", 9, "h()", "doc h", True),
    ], "project string, path string, elem_ord long, id string, name string, type string, line int, signature string, "
       "doc_comment string, exported boolean")
    docs = docs_of(spark, [("p", 1, "g", "a.py", "function", "manual g", None, "manual", T0, T0),
                           ("p", 2, "h", "a.py", "function", "doc h", None, "auto", T0, T0)])
    nd, counts, _ = M.seed_docs(el, docs, now=datetime.datetime(2025, 1, 1))
    c = counts.collect()[0]
    assert (c.created, c.skipped) == (2, 3)
    f = nd.where("element = 'f'").collect()[0]
    assert (f.content, f.path, f.source) == ("doc f2", "c.py", "auto")


def test_search_fixture(spark):
    files, el, _ = ts_tables(spark)
    hits = S.search(files, el, _docs(spark), "round").collect()
    top = hits[0]
    assert (top.element, top.score) == ("roundTo", 0.9)
    assert {h.source for h in hits} == {"code", "doc"}
    assert S.search(files, el, _docs(spark), "").count() == 0


TEXTS = ["Rounds a price to whole coins.", "Holds users.", "Removed thing.", "A free page.", None, "", "a-b  c_d", "camelCase docSearch; smalWidget", "--- x ---",
         "\U00010428\U00010429abc mixed", "\U0001042Aabc", "x" * 40 + "yz tail", "x" * 39 + "yz", "ends here", "here ends", "one two one two three", "ÄÖÜ straße ΣΑΣ"]
ASKED = ["whle prise", "A free page.", "ree pag", "e", "b  c", "-b", "--- x", "---", "smal widgt", "\U00010429\U00010428abc", "x" * 38 + "yz", "one two three", " ",
         "te wo one fre tail cins hlds thng pge " + "x y z a b c d e f g h i j k l m n o p q r s t u v w " * 2]


def test_stored_index_scores_like_the_expression(spark, tmp_path):
    d = spark.createDataFrame([("p", k, t) for k, t in enumerate(TEXTS)], "project string, doc_ord long, content string")
    index = SearchIndex.build(d, str(tmp_path / "index"))
    for q in ASKED:
        expected = {r.doc_ord: r.s for r in d.select("doc_ord", score_match(q, F.col("content")).alias("s")).collect()}
        if " " in q.strip():
            assert {r.doc_ord: r.content_score for r in S.long_text_score(d, q).collect()} == expected, q
        # The stored index never sees the texts again.
        assert {r.doc_ord: r.content_score for r in S.long_text_score(d.withColumn("content", F.lit("gone")), q, index).collect()} == expected, q


def test_edit_distance_counts_utf16_units(spark):
    pairs = [("\U00010428\U00010429", "\U00010429"), ("\U00010428a", "a"), ("\U00010428abc", "\U00010429abc"), ("abc", "abd"), ("\U00010428bcd", "xbcd"), ("\U00010428abcd", "\U0001F428xbcd"),
             ("\U00010428\U00010428abc", "\U00010428abc"), ("\U00010428\U00010428\U00010428", "\U00010428")]

    def units(text):
        raw = text.encode("utf-16-be")
        return [raw[i:i + 2] for i in range(0, len(raw), 2)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for q, _ in pairs:
        got = {r.t: r.near for r in spark.createDataFrame([(t,) for _, t in pairs], "t string").select("t", near(F.col("t"), q).alias("near")).collect()}
        for t, found in got.items():
            assert found == (distance(units(q), units(t)) <= (1 if len(units(q)) <= 4 else 2)), (q, t)


def test_near_tokens_share_a_key(spark):
    """Every token within the threshold of a query token is stored under a key that is looked up."""
    import random
    random.seed(3)
    tokens = sorted({"".join(random.choice("abc") for _ in range(random.randint(1, 9))) for _ in range(400)} | {"\U00010428bc", "\U00010428bcde"})
    stored = {r.t: set(r.k) for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", keys_of(F.col("t")).alias("k")).collect()}
    asked = tokens[::9]
    pairs = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", *[near(F.col("t"), q).alias(f"q{i}") for i, q in enumerate(asked)]).collect()
    for r in pairs:
        for i, q in enumerate(asked):
            if r[f"q{i}"]:
                assert stored[r.t] & asked_keys(q, fuzzy_threshold(q)), (q, r.t)


def test_ranks_of_many_hits(spark):
    rows = [("p", k, f"coin{k}", "", "page", "coins" if k % 3 else "coin", None, None, T0, T0) for k in range(500)]
    d = docs_of(spark, rows).repartition(7)
    got = S.doc_search(d, "coins").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 501))
    assert [r.doc_ord for r in got] == [r.doc_ord for r in sorted(got, key=lambda r: (-r.score, r.doc_ord))]


def test_doc_search_ranks(spark):
    r = S.doc_search(_docs(spark), "coins").collect()
    assert [x.rank for x in r] == list(range(1, len(r) + 1))
    assert r[0].element == "roundTo" and r[0].score == 1.0


def _md_files(out):
    import os
    found = {}
    for base, dirs, files in os.walk(out):
        dirs[:] = [x for x in dirs if not x.startswith("_")]
        for f in files:
            with open(os.path.join(base, f)) as fh:
                found[os.path.relpath(os.path.join(base, f), out)] = fh.read()
    return found


def test_markdown_files_follow_the_docs(spark, tmp_path):
    out = str(tmp_path / "md")
    d = _docs(spark)
    markdown.write_markdown(d, out)
    first = _md_files(out)
    assert set(first) == {"ts/functions/roundTo.md", "ts/classes/Cart.md", "ts/functions/gone.md", "ts/pages/Guide.md"}
    assert first["ts/classes/Cart.md"] == "# Cart\n\nHolds users.\n"
    moved = d.withColumn("type", F.when(F.col("element") == "Cart", F.lit("interface")).otherwise(F.col("type")))
    mv = M.markdown_moves(d, moved).collect()
    assert [(r.old_md_path, r.new_md_path) for r in mv] == [("classes/Cart.md", "types/Cart.md")]
    markdown.write_markdown(moved, out, before=d)
    assert set(_md_files(out)) == set(first) - {"ts/classes/Cart.md"} | {"ts/types/Cart.md"}  # exactly one file
    assert {(r.project, r.md_path, r.markdown) for r in markdown.read_markdown_files(spark, out).collect()} == {
        (k.split("/", 1)[0], k.split("/", 1)[1], v) for k, v in _md_files(out).items()}


def test_a_failed_markdown_write_leaves_the_old_state(spark, tmp_path):
    out = str(tmp_path / "md")
    d = _docs(spark)
    markdown.write_markdown(d, out)
    before = _md_files(out)
    bad = d.withColumn("markdown", F.when(F.col("element") == "Guide", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.lit("changed")))
    with pytest.raises(Exception, match="lost"):
        markdown.write_markdown(bad, out)
    assert _md_files(out) == before
    # a write that stopped after its journal is finished by the next one
    w = markdown._Writer(out)
    rows = [{"project": "ts", "md_path": "pages/Guide.md", "markdown": "late"}, {"project": "ts", "md_path": "functions/gone.md", "markdown": None}]
    message, done = w.write(iter(rows)), markdown.finish
    try:
        markdown.finish = lambda out: 0
        w.commit([message])
    finally:
        markdown.finish = done
    assert _md_files(out) == before and markdown.finish(out) == 1
    after = _md_files(out)
    assert after["ts/pages/Guide.md"] == "late" and "ts/functions/gone.md" not in after


def test_lag_in_order_matches_window(spark):
    import random

    from pyspark.sql import Window

    from codeatlas.plans.partitioning import lag_in_order

    rnd = random.Random(3)
    rows = [("p", "hot" if rnd.random() < 0.6 else f"n{rnd.randrange(5)}", f"f{rnd.randrange(40):02d}", i, f"c{rnd.randrange(3)}")
            for i in range(2000)]
    df = spark.createDataFrame(rows, "project string, name string, path string, elem_ord long, c string").repartition(7)
    df = df.withColumn("spare", F.lit("unused"))
    w = Window.partitionBy("project", "name").orderBy("path", "elem_ord")
    want = {(r.name, r.path, r.elem_ord): r.prev for r in df.withColumn("prev", F.lag("c").over(w)).collect()}
    for settings in ({"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"},
                     {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "31"}):
        before = {k: spark.conf.get(k) for k in settings}
        try:
            for k, v in settings.items():
                spark.conf.set(k, v)
            for _ in range(3):
                got = {(r.name, r.path, r.elem_ord): r.prev for r in
                       lag_in_order(df, ["project", "name"], ["path", "elem_ord"], "c", "prev").select("name", "path", "elem_ord", "prev").collect()}
                assert got == want
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)


def test_contained_phrases_shuffle_matches_only(spark):
    """No join of all words with a vocabulary, whatever the sizes: the words are filtered where they are read."""
    docs = docs_of(spark, [("p", k, f"e{k}", "", "page", f"one Alpha-beta gamma{k} tail", [], "manual", T0, T0) for k in range(40)])
    index = SearchIndex.build(docs)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for q, n in [("alpha-beta gamma7", 1), ("pha-beta gamma1", 11), ("lph", 40), ("one alpha-beta gam", 40), ("ne alpha beta", 0)]:
            found = index.containing(q)
            assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
            assert found.count() == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_code_rows_are_dealt_before_they_are_scored(spark):
    files, el, _ = ts_tables(spark)
    whole = S.code_hits(files, el, "roundTo")
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("levenshtein") < plan.index("RepartitionByExpression")
    assert whole.count() == files.count() + el.count()
