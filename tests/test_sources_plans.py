import datetime
import json
import os
import tempfile

from pyspark.sql import functions as F

import pytest

from codeatlas.operators import card, maintain
from codeatlas.plans import briefing
from codeatlas.plans.build import build_from_trees
from codeatlas.sources import runs, snapshots, tables
from codeatlas.sources.manifest import detect_language, manifests
from codeatlas.sources.source_tree import scan_sources, tree_paths
from tests.fixtures import PY_CLI, PY_TARIFF, TS_INDEX, TS_MONEY
from tests.helpers import T0, docs_of, ts_tables


def _tree():
    d = tempfile.mkdtemp(prefix="codeatlas-tree-", dir="/tmp")
    for p, text in {
        "ts/src/index.ts": TS_INDEX, "ts/src/money.ts": TS_MONEY, "ts/src/distance.ts": "export const d = 1;",
        "ts/dist/a.ts": "x", "ts/node_modules/m/i.ts": "x", "ts/src/_hidden.ts": "export function h() {}",
        "ts/types.d.ts": "export type Q = 1;", "ts/.ts": "x", "ts/tsconfig.json": "{}",
        "ts/package.json": json.dumps({"main": "src/index.ts", "bin": "bin/run.js", "devDependencies": {"next": "1"}}),
        "py/cli.py": PY_CLI, "py/tariff.py": PY_TARIFF, "py/pkg/__init__.py": "X = 1\n", "py/x.egg-info/a.py": "y = 1\n",
        "py/pyproject.toml": "",
    }.items():
        full = os.path.join(d, p)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as fh:
            fh.write(text)
    return d


def test_listing_prunes_and_keeps_hidden_names(spark):
    d = _tree()
    got = sorted(r.path for r in tree_paths(spark, {"ts": f"{d}/ts"}, ["dist", "node_modules"]).collect())
    assert got == [".ts", "package.json", "src/_hidden.ts", "src/distance.ts", "src/index.ts", "src/money.ts", "tsconfig.json", "types.d.ts"]
    every = {r.path: r.ignored for r in tree_paths(spark, {"ts": f"{d}/ts"}, ["dist", "node_modules"], enter_ignored=True).collect()}
    assert every["node_modules/m/i.ts"] and every["dist/a.ts"] and not every["src/index.ts"]
    scanned = sorted(r.path for r in scan_sources(spark, {"ts": f"{d}/ts"}, ["dist", "node_modules"], [".ts"]).collect())
    assert scanned == ["src/_hidden.ts", "src/distance.ts", "src/index.ts", "src/money.ts", "types.d.ts"]  # ".ts" has no extension
    py = sorted(r.path for r in scan_sources(spark, {"py": f"{d}/py"}, ["*.egg-info"], [".py"]).collect())
    assert py == ["cli.py", "pkg/__init__.py", "tariff.py"]


def test_listing_of_wide_and_deep_trees(spark):
    d = tempfile.mkdtemp(prefix="codeatlas-tree-", dir="/tmp")
    deep = "/".join(f"l{k}" for k in range(6))
    names = [f"wide/f{k}.ts" for k in range(300)] + [f"dirs/d{k}/x.ts" for k in range(40)] + [f"{deep}/end.ts"]
    for n in names:
        os.makedirs(os.path.dirname(f"{d}/{n}"), exist_ok=True)
        with open(f"{d}/{n}", "w") as fh:
            fh.write(f"// {n}\n")
    os.symlink(d, f"{d}/loop")
    src = scan_sources(spark, {"p": d}, [], [".ts"], files_per_partition=50)
    assert {r.path: r.content for r in src.collect()} == {n: f"// {n}\n" for n in names}
    assert src.rdd.getNumPartitions() == 7


def test_imports_of_files_outside_the_scan(spark):
    d = tempfile.mkdtemp(prefix="codeatlas-tree-", dir="/tmp")
    for p, text in {"src/a.ts": "import data from './data.json';\nimport { x } from '../dist/lib.js';\nimport { y } from './gone';\n", "src/data.json": "{}", "dist/lib.ts": "x",
                    "tsconfig.json": "{}", "package.json": "{}"}.items():
        os.makedirs(os.path.dirname(f"{d}/{p}"), exist_ok=True)
        with open(f"{d}/{p}", "w") as fh:
            fh.write(text)
    t = build_from_trees(spark, {"p": d}, {"p": "typescript"}, ignore=["dist"])
    assert [r.dst_path for r in t.edges.orderBy("edge_ord").collect()] == ["src/data.json", "dist/lib.ts", "./gone"]
    assert [r.path for r in t.files.collect()] == ["src/a.ts"]


def test_cleanup_removes_what_a_run_stored(spark, monkeypatch):
    from codeatlas import session
    from codeatlas.plans.stored import stored

    own = tempfile.mkdtemp(prefix="codeatlas-run-", dir="/tmp")
    monkeypatch.setattr(session, "run_folder", lambda spark: f"{own}/run-x")
    monkeypatch.setattr("codeatlas.plans.stored.run_folder", lambda spark: f"{own}/run-x")
    assert stored(spark.range(3)).count() == 3 and len(os.listdir(f"{own}/run-x")) == 1
    assert session.cleanup(spark) and not os.path.exists(f"{own}/run-x")


def test_snapshots_are_whole_and_conflicts_fail(spark):
    base = tempfile.mkdtemp(prefix="codeatlas-snap-", dir="/tmp")
    files, el, edges = ts_tables(spark)
    assert snapshots.snapshot(spark, base) == snapshots.NONE and snapshots.read(spark, base, "edges").count() == 0
    at = datetime.datetime(2025, 3, 1, tzinfo=datetime.timezone.utc)
    one = snapshots.commit(spark, base, {"files": files, "elements": el, "edges": edges}, at)
    assert (one.version, snapshots.snapshot(spark, base).generated_at) == (1, at)
    # a reader that has taken a snapshot goes on seeing it while a build is committed
    two = snapshots.commit(spark, base, {"edges": edges.where("type = 'call'"), "files": files.limit(1)}, since=one)
    assert (snapshots.read(spark, base, "edges", one).count(), snapshots.read(spark, base, "files", one).count()) == (7, 2)
    assert (snapshots.read(spark, base, "edges").count(), snapshots.read(spark, base, "files").count(), snapshots.read(spark, base, "elements").count()) == (5, 1, 6)
    with pytest.raises(snapshots.ConflictError):  # a second writer that started from the first snapshot
        snapshots.commit(spark, base, {"edges": edges}, since=one)
    assert snapshots.snapshot(spark, base).version == two.version == 2
    assert {(r.version, r.table_name) for r in snapshots.log(spark, base).collect()} == {(v, t) for v in (1, 2) for t in ("files", "elements", "edges")}
    assert snapshots.vacuum(spark, base) == 3 and snapshots.read(spark, base, "edges").count() == 5


def test_doc_updates_write_only_touched_buckets(spark):
    base = tempfile.mkdtemp(prefix="codeatlas-docs-", dir="/tmp")
    files, el, _ = ts_tables(spark)
    docs = docs_of(spark, [("ts", k, f"page{k}", "", "page", f"text {k}", None, None, T0, T0) for k in range(200)])
    one = snapshots.commit(spark, base, {"docs": docs})
    assert len(one.tables["docs"]) > 50
    changes = spark.createDataFrame([("ts", 1, "page7", "new"), ("ts", 2, "fresh", "more")], "project string, change_ord long, element string, content string")
    stored = snapshots.read(spark, base, "docs")
    new, _ = maintain.doc_add(files, el, stored, changes, now=datetime.datetime(2025, 1, 1))
    two = snapshots.update_docs(spark, base, new, changes)
    moved = [b for b in two.tables["docs"] if two.tables["docs"][b] != one.tables["docs"].get(b)]
    assert 1 <= len(moved) <= 2 and len(two.tables["docs"]) >= len(one.tables["docs"])
    got = {r.element: r.content for r in snapshots.read(spark, base, "docs").collect()}
    assert got == {**{f"page{k}": f"text {k}" for k in range(200)}, "page7": "new", "fresh": "more"}
    assert snapshots.read(spark, base, "docs", one).where("content = 'new'").count() == 0


def test_scan_detect_and_build(spark):
    d = _tree()
    roots = {"ts": f"{d}/ts", "py": f"{d}/py"}
    src = scan_sources(spark, roots, extensions=[".ts", ".py", ".json", ".toml"], files_per_partition=2)
    assert src.where("path = 'pkg/__init__.py'").count() == 1
    assert src.where(F.col("mtime").isNull()).count() == 0
    lang = {r.project: (r.language, r.framework, r.source_paths) for r in detect_language(src).collect()}
    assert lang == {"ts": ("typescript", "next.js", ["src"]), "py": ("python", None, ["."])}
    m = manifests(src).collect()[0]
    assert (m.main, m.bins) == ("src/index.ts", ["bin/run.js"])
    t = build_from_trees(spark, roots)
    paths = {(r.project, r.path) for r in t.files.collect()}
    assert ("ts", "types.d.ts") not in paths  # outside the detected source root
    assert ("ts", "src/_hidden.ts") in paths and ("py", "pkg/__init__.py") in paths
    assert t.edges.where("project = 'py'").count() == 17


def test_versioned_tables(spark):
    base = tempfile.mkdtemp(prefix="codeatlas-tables-", dir="/tmp")
    assert tables.read_table(spark, base, "edges").count() == 0
    files, el, edges = ts_tables(spark)
    assert tables.write_table(edges, base, "edges") == 1
    back = tables.read_table(spark, base, "edges")
    assert back.count() == 7
    assert tables.write_table(back.where("type = 'call'"), base, "edges") == 2  # reads v1, writes v2
    assert tables.read_table(spark, base, "edges").count() == 5
    js = tables.to_json_lines(edges).collect()[0].json
    assert json.loads(js)["project"] == "ts"


def test_card_and_briefing(spark):
    files, el, edges = ts_tables(spark)
    docs = docs_of(spark, [("ts", 1, "roundTo", "src/money.ts", "function", "Formats.", ["fmt"], "manual", T0, T0)])
    names = spark.createDataFrame([("ts", n) for n in ("roundTo", "fmt", "src/index.ts", "nothing")],
                                  "project string, name string")
    c = {r.element: r for r in card.explain(files, el, edges, docs, names).collect()}
    fg = c["roundTo"]
    assert (fg.type, fg.location, fg.n_dependents, fg.n_calls) == ("function", "src/money.ts:9", 3, 0)
    assert fg.documentation == "# roundTo\n\nFormats.\n"
    assert (c["fmt"].status, c["fmt"].documentation, c["fmt"].location) == ("found", "Formats.", "src/money.ts")
    assert [x.name for x in c["src/index.ts"].children] == ["checkout", "Cart"]
    assert c["nothing"].status == "not_found"
    b = briefing.context(files, el, edges, docs).collect()[0]
    assert (b.architecture.files, b.architecture.elements, b.dependencies.total, b.documentation.total) == (2, 6, 7, 1)
    assert b.dependencies.hotspots[0].element == "src/index.ts"
    assert b.entry_points_count == 1 and b.public_api_count == 6 and b.generated_at is not None


def test_run_records(spark):
    d = tempfile.mkdtemp(prefix="codeatlas-runs-", dir="/tmp")
    recs = [
        {"case": "c1", "mode": "zero", "wall_s": 10.0, "input_tokens": 100, "output_tokens": 10, "cost_usd": 0.5, "result": "x" * 400},
        {"case": "c1", "mode": "tool", "wall_s": 7.5, "input_tokens": 50, "cost_usd": 0.25},
        {"case": "c1", "mode": "tool", "wall_s": 6.0, "input_tokens": 40, "cost_usd": 0.2},
        {"case": "c2", "mode": "tool", "wall_s": 1.0},
    ]
    with open(f"{d}/runs.jsonl", "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in recs))
    r = runs.run_totals(runs.read_runs(spark, f"{d}/runs.jsonl"))
    first = r.orderBy("seq").collect()[0]
    assert first.total_tokens == 110 and len(first.result_excerpt) == 280
    dl = runs.run_deltas(r).collect()
    assert [(x.case, x.mode, x.d_wall_s, x.d_total_tokens, x.d_cost_usd) for x in dl] == [("c1", "tool", -4.0, -70, -0.3)]
    assert datetime is not None


def test_build_makes_its_input_once(spark):
    from codeatlas.plans.build import build

    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    src = spark.createDataFrame([("p", f"a{k}.py", f"def f{k}(x):\n    return g(x)\n") for k in range(5)] + [("p", "no.py", None)], "project string, path string, content string")
    projects = spark.createDataFrame([("p", "python")], "project string, language string")
    t = build(src.mapInArrow(rows, src.schema), projects)
    assert t.files.count() == t.elements.count() == 5 and t.edges.where("type = 'call'").count() > 0
    assert made.value == 6
