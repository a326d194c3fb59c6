from pyspark.sql import functions as F

from codeatlas.operators import extract_python as xp
from tests.fixtures import py_project, source_files


def test_python_elements_fixture(spark):
    el = xp.python_elements(py_project(spark)).orderBy("path", "elem_ord").collect()
    got = [(r.path, r.elem_ord, r.name, r.type, r.line, r.signature, r.exported) for r in el]
    assert got == [
        ("cli.py", 1, "run", "function", 4, "run()", True),
        ("cli.py", 2, "Desk", "class", 9, "class Desk", True),
        ("cli.py", 3, "NightDesk", "class", 17, "class NightDesk(Desk)", True),
        ("tariff.py", 1, "BASE_FEE", "variable", 1, None, True),
        ("tariff.py", 2, "fee_for", "function", 4, "fee_for(key)", True),
        ("tariff.py", 3, "shown", "function", 8, "shown(key)", True),
        ("tariff.py", 4, "_half", "function", 12, "_half()", False),
    ]


def test_python_edges_fixture(spark):
    e = xp.python_edges(py_project(spark))
    counts = {r.type: r["count"] for r in e.groupBy("type").count().collect()}
    assert counts == {"import": 2, "call": 14, "extends": 1}
    imports = sorted((r.src_path, r.dst_path, r.to_element) for r in e.where("type = 'import'").collect())
    assert imports == [("cli.py", "tariff.py", "fee_for"), ("cli.py", "tariff.py", "shown")]
    ext = e.where("type = 'extends'").collect()[0]
    assert (ext.from_element, ext.to_element) == ("NightDesk", "Desk")
    calls = xp.python_calls(xp.lines_of(py_project(spark))).orderBy("path", "line_no", "pos").collect()
    got = [(r.path, r.line_no, r.caller, r.callee) for r in calls]
    assert got == [
        ("cli.py", 4, "run", "run"), ("cli.py", 5, "run", "NightDesk"), ("cli.py", 6, "run", "desk.charge_all"),
        ("cli.py", 10, "charge", "charge"), ("cli.py", 11, "charge", "fee_for"),
        ("cli.py", 13, "label", "label"), ("cli.py", 14, "label", "shown"),
        ("cli.py", 17, "label", "NightDesk"), ("cli.py", 18, "charge_all", "charge_all"), ("cli.py", 19, "charge_all", "self.charge"),
        ("tariff.py", 4, "fee_for", "fee_for"), ("tariff.py", 5, "fee_for", "shown"),
        ("tariff.py", 8, "shown", "shown"), ("tariff.py", 12, "_half", "_half"),
    ]


def test_docstrings_single_multi_and_eof(spark):
    src = "\n".join([
        'def a():',
        '    """One line."""',
        'def b():',
        '',
        "    '''first",
        '    second',
        "    third''' tail",
        'class C:',
        '    "unterminated',
        '    rest of file',
    ])
    el = xp.python_elements(source_files(spark, [("p", "m.py", src)])).orderBy("elem_ord").collect()
    docs = {r.name: r.doc_comment for r in el}
    assert docs["a"] == "One line."
    assert docs["b"] == "first\n    second\n    third"
    assert docs["C"] == "unterminated\n    rest of file"


def test_docstring_needs_quote_within_two_lines(spark):
    src = "def a():\n\n\n    '''late'''\ndef b():\n    x = 1\n    '''no'''\n"
    el = xp.python_elements(source_files(spark, [("p", "m.py", src)])).collect()
    assert all(r.doc_comment is None for r in el)


def test_import_forms(spark):
    src = "import os, sys as system\nfrom .utils import a as b, c\n  from x.y import (z\n"
    imp = xp.python_imports(xp.lines_of(source_files(spark, [("p", "m.py", src)]))).orderBy("line_no", "pos").collect()
    assert [(r.module, r.name) for r in imp] == [("os", None), ("sys", None), (".utils", "a"), (".utils", "c"), ("x.y", "(z")]
    edges = xp.python_edges(source_files(spark, [("p", "m.py", src)])).where("type='import'")
    assert sorted(r.dst_path for r in edges.collect())[0] == "/utils.py"


def test_scope_reset_and_class_keep(spark):
    src = "def f():\n    g()\nx = h()\nclass K(Base):\n    k()\n        def deep():\n    m()\n"
    c = xp.python_calls(xp.lines_of(source_files(spark, [("p", "m.py", src)]))).orderBy("line_no", "pos").collect()
    got = [(r.line_no, r.caller, r.callee) for r in c]
    assert got == [(1, "f", "f"), (2, "f", "g"), (3, None, "h"), (4, None, "K"), (5, None, "k"),
                   (6, None, "deep"), (7, None, "m")]
    assert F is not None


def _long_file(n):
    part = ['def f{k}(a):', '    """Doc {k}', '    goes on', "    here.\"\"\"", '    return g{k}(a)', 'class K{k}(Base, object):', "    '''one'''",
            '    def m(self):', '        self.go{k}()', '', 'x{k} = h({k})', 'from a.b{k} import c as d, e', 'def last{k}(): ', '', "    'open {k}", '    run()']
    return "\n".join(line.replace("{k}", str(k)) for k in range(n) for line in part)


def test_blocks_of_any_size_give_the_same_rows(spark):
    """Markers, docstrings and numbers that cross the borders of blocks."""
    src = source_files(spark, [("p", "hot.py", _long_file(12)), ("p", "a.py", "def a():\n    '''x\n\ny''' z\nb()"), ("q", "e.py", ""), ("q", "one.py", "f()")])
    whole = [sorted(map(str, f(src).collect())) for f in (xp.python_elements, xp.python_edges)]
    for size in (1, 2, 3, 7, 64):
        assert [sorted(map(str, f(src, size).collect())) for f in (xp.python_elements, xp.python_edges)] == whole, size


def test_a_hot_file_spreads_over_tasks(spark):
    """A file with most lines: the rows of its blocks go to several tasks."""
    src = source_files(spark, [("p", "hot.py", _long_file(400)), ("p", "a.py", "f()\n")])
    from pyspark.sql import functions as G
    from codeatlas.plans.partitioning import numbered
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        calls = xp.python_calls(xp.lines_of(src, 64))
        rows = numbered(calls, ["project", "path"], ["block"], ["line_no", "pos"], "n").select(G.spark_partition_id().alias("t")).groupBy("t").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) >= 4 and max(r["count"] for r in rows) < sum(r["count"] for r in rows) / 2
