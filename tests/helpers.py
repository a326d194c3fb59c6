"""Shared builders: tables of the two fixture projects."""

import datetime

from codeatlas.operators import extract_python as xp
from codeatlas.operators import extract_ts as xt
from codeatlas.operators.nodes import file_exports
from tests.fixtures import py_project, ts_project

DOC_SCHEMA = ("project string, doc_ord long, element string, path string, type string, content string, markdown string, "
              "aliases array<string>, source string, created_at timestamp, updated_at timestamp")
T0 = datetime.datetime(2024, 1, 1)
T1 = datetime.datetime(2024, 6, 1)


def ts_tables(spark):
    src = ts_project(spark)
    el = xt.ts_elements(src)
    return file_exports(el), el, xt.ts_edges(src)


def py_tables(spark):
    src = py_project(spark)
    el = xp.python_elements(src)
    return file_exports(el), el, xp.python_edges(src)


def docs_of(spark, rows):
    """rows: (project, doc_ord, element, path, type, content, aliases, source, created, updated)."""
    full = [(p, o, e, pa, t, c, f"# {e}\n\n{c}\n", a, s, cr, up) for p, o, e, pa, t, c, a, s, cr, up in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)
