import pytest
from pyspark.sql import functions as F

from codeatlas.functions import ignore as ig
from codeatlas.functions import score as sc
from codeatlas.functions import text as tx


def one(spark, col, value="x"):
    return spark.range(1).select(col.alias("v")).collect()[0].v


@pytest.mark.parametrize("q,t,expected", [
    ("popap", "popup", 0.6),
    ("smal widgt", "small widget", 0.6),
    ("smal widgt", "blue widget", 0.3),
    ("greeting", "formatGreeting", 0.9),
    ("user make", "makeUserNow", 0.8),
    ("", "anything", 0.0),
    ("Format", "format", 1.0),
    ("  ", "a b", 0.9),
    ("zzz", "", 0.0),
    ("abc abc", "abc", 0.8),
    ("abd xyz", "abc", 0.3),
])
def test_score_match(spark, q, t, expected):
    assert one(spark, sc.score_match(q, F.lit(t))) == pytest.approx(expected)


def test_tokenize(spark):
    assert one(spark, sc.tokenize(F.lit("docSearch_v2/fooBAR.ts"))) == ["doc", "search", "v2", "foo", "bar", "ts"]
    assert sc.tokenize_py("docSearch_v2/fooBAR.ts") == ["doc", "search", "v2", "foo", "bar", "ts"]


@pytest.mark.parametrize("path,patterns,hit", [
    ("dist", ["dist"], True),
    ("src/distance.ts", ["dist"], False),
    ("dist/a.ts", ["dist"], True),
    ("x.egg-info/a.py", ["*.egg-info"], True),
    ("src/generated/a.ts", ["src/generated"], True),
    ("pkg/__init__.py", ig.DEFAULT_IGNORE, False),
    ("node_modules/x/i.ts", ig.DEFAULT_IGNORE, True),
])
def test_is_ignored(spark, path, patterns, hit):
    assert one(spark, ig.is_ignored(F.lit(path), patterns)) is hit
    assert ig.is_ignored_py(path, patterns) is hit


def test_path_helpers(spark):
    assert one(spark, tx.basename(F.lit("a/b/c.test.ts"))) == "c.test.ts"
    assert one(spark, tx.stem(F.lit("a/b/c.test.ts"))) == "c.test"
    assert one(spark, tx.extension(F.lit("a/b/c.test.ts"))) == ".ts"
    assert one(spark, tx.extension(F.lit("a/.env"))) == ""
    assert one(spark, tx.dirname(F.lit("a/b/c.ts"))) == "a/b"
    assert one(spark, tx.module_to_path(F.lit("a.b.c"))) == "a/b/c.py"
    assert one(spark, tx.normalise_path(F.lit("src/a/../b/./c.ts"))) == "src/b/c.ts"
    assert one(spark, tx.join_path(F.lit("src/x"), F.lit("../utils"))) == "src/utils"


def test_labels_and_ids(spark):
    assert one(spark, tx.diagram_id(F.lit("src/main.ts"), F.lit("main"))) == "src_main_ts_main"
    assert one(spark, tx.diagram_id(F.lit("src/main.ts"), F.lit(None).cast("string"))) == "src_main_ts"
    assert one(spark, tx.dot_quote(F.lit('a"b'))) == '"a\\"b"'
    assert one(spark, tx.location(F.lit("a.py"), F.lit(0))) == "a.py"
    assert one(spark, tx.location(F.lit("a.py"), F.lit(7))) == "a.py:7"
    assert one(spark, tx.node_key(F.lit(""), F.lit("p.ts"))) == "p.ts"
    assert one(spark, tx.edge_label(F.lit("p.ts"), F.lit("f"))) == "p.ts:f"


def test_doc_paths_and_types(spark):
    assert one(spark, tx.type_dir(F.lit("enum"))) == "types"
    assert one(spark, tx.type_dir(F.lit("weird"))) == "other"
    assert one(spark, tx.doc_file_path(F.lit("src/my file.ts"), F.lit("file"))) == "files/src/my_file.ts.md"
    assert one(spark, tx.detect_type(F.lit("src/x.vue"))).asDict() == {"type": "file", "path": "src/x.vue"}
    assert one(spark, tx.detect_type(F.lit("Widget"))).asDict() == {"type": "unknown", "path": ""}
    assert one(spark, tx.markdown_body(F.lit("e"), F.lit("c"))) == "# e\n\nc\n"
