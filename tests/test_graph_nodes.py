from pyspark.sql import functions as F

from codeatlas.operators import graph, nodes, render
from tests.helpers import py_tables, ts_tables


def test_hotspots_ts_fixture(spark):
    files, el, edges = ts_tables(spark)
    got = {r.element: r.total for r in graph.hotspots(edges, k=10).collect()}
    assert got == {"src/index.ts": 4, "addTax": 3, "roundTo": 3, "checkout": 2, "report.send": 1,
                   "cart.sum": 1}


def test_hotspots_skewed_hub_matches_brute_force(spark):
    rows = [("p", i, "a.ts", "b.ts", "call", None if i % 3 else "f", "hub" if i % 2 else f"x{i % 7}") for i in range(3000)]
    edges = spark.createDataFrame(rows, "project string, edge_ord long, src_path string, dst_path string, type string, "
                                        "from_element string, to_element string")
    deg = {}
    for _, _, s, d, _, fe, te in rows:
        deg.setdefault(fe or s, [0, 0])[1] += 1
        deg.setdefault(te or d, [0, 0])[0] += 1
    want = sorted(((-(i + o), k, i, o) for k, (i, o) in deg.items()))[:3]
    got = [(-r.total, r.element, r.inbound, r.outbound) for r in graph.hotspots(edges, k=3).orderBy("rank").collect()]
    assert got == want


def test_deps_and_calls_quirks(spark):
    _, _, edges = ts_tables(spark)
    d = graph.deps(edges, "roundTo").collect()
    assert len(d) == 3  # import + two calls, exact element match
    # a file name also returns that file's own internal calls (calls point at their own file)
    assert graph.deps(edges, "money.ts").count() == 3
    assert graph.calls(edges, "checkout").count() == 2  # element match
    assert graph.calls(edges, "index").count() == 6  # src path contains 'index'


def test_edge_summary_and_counts(spark):
    _, _, edges = py_tables(spark)
    r = graph.edge_summary(edges).collect()[0]
    assert (r.total, r.imports, r.calls, r.extends, r.implements) == (17, 2, 14, 1, 0)


def test_neighbourhoods_match_brute_force(spark):
    files, el, edges = ts_tables(spark)
    e_rows = edges.collect()
    fe = graph.file_edges(edges, files, limit=None).collect()
    for f in files.collect():
        want = sum(1 for r in e_rows if r.src_path == f.path or r.dst_path == f.path)
        assert sum(1 for r in fe if r.file == f.path) == want
    ee = graph.element_edges(edges, el, limit=None).collect()
    for x in el.collect():
        want = sum(1 for r in e_rows if r.from_element == x.name or r.to_element == x.name
                   or (r.src_path == x.path and r.from_element is None) or (r.dst_path == x.path and r.to_element is None))
        assert sum(1 for r in ee if (r.elem_path, r.elem_ord) == (x.path, x.elem_ord)) == want


def test_browse_edges_remaining_is_true_count(spark):
    _, _, edges = py_tables(spark)
    b = graph.browse_edges(edges, text="FEE", edge_type="call", limit=2).collect()
    assert len(b) == 2 and b[0].remaining == 3 - 2


def test_public_api_coverage_inputs(spark):
    files, el, _ = ts_tables(spark)
    api = {r.name for r in nodes.public_api(el).collect()}
    assert api == {"checkout", "Cart", "roundTo", "addTax", "_half", "CURRENCY"}
    s = nodes.build_summary(files, el).collect()[0]
    assert (s.files, s.elements) == (2, 6)


def test_arch_show_falls_back_to_children(spark):
    files, el, _ = ts_tables(spark)
    by_file = nodes.arch_show(files, el, "money").collect()
    assert [r.path for r in by_file] == ["src/money.ts"] and len(by_file[0].children) == 4
    by_child = nodes.arch_show(files, el, "round").collect()
    assert [(r.path, [c.name for c in r.children]) for r in by_child] == [("src/money.ts", ["roundTo"])]


def test_entry_points_and_known_names(spark):
    files, el, _ = ts_tables(spark)
    man = spark.createDataFrame([("ts", "dist/index.js", ["bin/cli.js", "src/index.ts"])], "project string, main string, bins array<string>")
    eps = [r.entry for r in nodes.entry_points(files.withColumn("project", F.lit("ts")), man).orderBy("ord").collect()]
    assert eps == ["src/index.ts", "dist/index.js", "bin/cli.js"]
    k = {r.known for r in nodes.known_names(files, el).collect()}
    assert {"index.ts", "src/index.ts", "checkout", "src/index.ts:checkout"} <= k


def test_render_tree_ts(spark):
    files, el, _ = ts_tables(spark)
    lines = [r.line for r in render.render_tree(files, el).orderBy("path", "elem_ord").collect()]
    assert lines == [
        "├── index.ts (exports: checkout, Cart)",
        "│   ├── checkout [function] (exports: checkout)",
        "│   └── Cart [class] (exports: Cart)",
        "└── money.ts (exports: addTax, roundTo, CURRENCY)",
        "    ├── addTax [function] (exports: addTax)",
        "    ├── _half [function]",
        "    ├── roundTo [function] (exports: roundTo)",
        "    └── CURRENCY [variable] (exports: CURRENCY)",
    ]


def test_mermaid_and_dot(spark):
    _, _, edges = ts_tables(spark)
    m = [r.line for r in render.render_mermaid_edges(edges).orderBy("section", "edge_ord").collect()]
    assert m[0] == "graph LR" and "  src_index_ts -->|import| src_money_ts_addTax" in m
    d = [r.line for r in render.render_dot(edges).orderBy("section", "edge_ord").collect()]
    assert d[:2] == ["digraph dependencies {", "  rankdir=LR;"] and d[-1] == "}"
    assert '  "src/index.ts.checkout" -> "src/index.ts.report.send" [label="call"];' in d
    u = render.diagram_edges(edges, limit=100).count()
    assert u == 7


def test_element_edges_limit_exact_with_shared_hub_name(spark):
    import random

    rnd = random.Random(7)
    names = ["main", "main", "main", "util", "x"]
    paths = ["a.ts", "b.ts", "c.ts", "a.ts", "d.ts"]
    names, paths = names + ["main"], paths + ["a.ts"]  # the id a.ts:main twice
    elems = spark.createDataFrame([("p", f"{pa}:{n}", n, pa, i) for i, (n, pa) in enumerate(zip(names, paths, strict=True))],
                                  "project string, id string, name string, path string, elem_ord long")
    rows = []
    for i in range(400):
        fe = rnd.choice(["main", "util", None, "x", "other"])
        te = rnd.choice(["main", "util", None, "other"])
        rows.append(("p", rnd.randrange(50), rnd.choice(paths), rnd.choice(paths), rnd.choice(["call", "import"]), fe, te))
    edges = spark.createDataFrame(rows, "project string, edge_ord long, src_path string, dst_path string, type string, "
                                        "from_element string, to_element string")
    got = {}
    for r in graph.element_edges(edges, elems, limit=3).collect():
        got.setdefault(r.elem_ord, []).append((r.pos, r.edge_ord, r.src_path, r.dst_path, r.type, r.from_element, r.to_element))
    key = lambda e: (e[1], e[2], e[3], e[4], e[5] is not None, e[5] or "", e[6] is not None, e[6] or "")
    for el in elems.collect():
        hits = sorted((e for e in rows if e[5] == el.name or e[6] == el.name or (e[5] is None and e[2] == el.path)
                       or (e[6] is None and e[3] == el.path)), key=key)[:3]
        assert [g[1:] for g in sorted(got.get(el.elem_ord, []))] == [h[1:] for h in hits]


def test_render_formats_and_browser_tree(spark):
    import json

    files, el, edges = ts_tables(spark)
    arch = [json.loads(r.json) for r in render.render_arch(files, el, "json").collect()]
    assert sorted(a["path"] for a in arch) == ["src/index.ts", "src/money.ts"]
    assert render.render_deps(edges, "json").count() == 7
    inline = [r.line for r in render.render_mermaid_tree(files, el, inline_children=True)
              .orderBy("path", "elem_ord", "part").collect()]
    assert inline[:3] == ["graph TD", '  src_index_ts["index.ts"]', '  src_index_ts --> src_index_ts_checkout["checkout (function)"]']


def test_element_edges_repeated_elements_share_a_limit(spark):
    els = [("p", "a.ts:f", "f", "a.ts", 1), ("p", "a.ts:f", "f", "a.ts", 1), ("p", "a.ts:g", "g", "a.ts", None), ("p", "a.ts:h", "h", "a.ts", None),
           ("p", "b.ts:g", "g", "b.ts", 2), ("p", "none", None, "a.ts", 3), ("p", "nowhere", "g", None, 4), ("p", "lone", "x", "c.ts", 5)]
    elems = spark.createDataFrame(els, "project string, id string, name string, path string, elem_ord long")
    rows = [("p", i, "a.ts" if i % 5 else "b.ts", "a.ts" if i % 3 else "d.ts", "call", (None, "f", "g", "h")[i % 4], (None, "g", "f")[i % 3]) for i in range(60)]
    rows += rows[:9]
    edges = spark.createDataFrame(rows, "project string, edge_ord long, src_path string, dst_path string, type string, "
                                        "from_element string, to_element string")
    pools = {}
    for _, _, name, path, place in els:
        pools.setdefault((path, place), []).extend(
            e[1:] for e in rows if name is not None and name in (e[5], e[6]) or (path is not None and (e[5] is None and e[2] == path or e[6] is None and e[3] == path)))
    got = {}
    for r in graph.element_edges(edges, elems, limit=7).collect():
        got.setdefault((r.elem_path, r.elem_ord), []).append((r.pos, r.edge_ord, r.src_path, r.dst_path, r.type, r.from_element, r.to_element))
    for k, pool in pools.items():
        assert sorted(got.get(k, [])) == [(i, *e) for i, e in enumerate(sorted(pool, key=lambda e: e[0])[:7], 1)]
    assert set(got) <= set(pools) and len(got) == 5


_MEMORY = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
from codeatlas.operators import graph
spark = SparkSession.builder.master("local[2]").config(map={"spark.sql.shuffle.partitions": "2", "spark.buffer.pageSize": "1m", "spark.ui.enabled": "false",
    "spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + sys.argv[2], "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"}).getOrCreate()
text = lambda s, n: F.concat(F.lit(s), (F.col("id") % n).cast("string"))
elems = spark.range(20000).select(F.lit("p").alias("project"), F.col("id").cast("string").alias("id"), text("name", 40).alias("name"), text("path", 30).alias("path"), F.col("id").alias("elem_ord"))
edges = spark.range(9000).select(F.lit("p").alias("project"), F.col("id").alias("edge_ord"), text("path", 30).alias("src_path"), text("path", 7).alias("dst_path"), F.lit("call").alias("type"),
                                 F.when(F.col("id") % 3 > 0, text("name", 40)).alias("from_element"), F.lit("other").alias("to_element"))
out = graph.element_edges(edges, elems, limit=50)
out.write.format("noop").mode("overwrite").save()
spark.stop()
"""


def test_element_edges_sorts_no_edge_per_element(tmp_path):
    import json
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(graph.__file__ + "/..")))
    subprocess.run([sys.executable, "-c", _MEMORY, repo, str(tmp_path)], check=True, capture_output=True, timeout=300)
    tasks = [json.loads(line) for f in tmp_path.iterdir() if not f.name.startswith(".") for line in f.open() if '"SparkListenerTaskEnd"' in line]
    # 20,000 elements have 50 edges each; when they were sorted as rows, a task took 121 MB
    assert tasks and max(t["Task Metrics"]["Peak Execution Memory"] for t in tasks) < 40e6
