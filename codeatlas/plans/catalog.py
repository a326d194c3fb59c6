"""Registered queries over the driver tables: name -> (spark, sf_dir) -> DataFrame,
with the DuckDB SQL that must return the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions.text import basename
from codeatlas.operators import docs as docops
from codeatlas.operators import card, extract_python, extract_ts, graph, maintain, nodes, render
from codeatlas.operators import search as search_ops
from codeatlas.operators.search_index import SearchIndex
from codeatlas.plans import briefing, build
from codeatlas.plans.oracle import sql_score, with_views
from codeatlas.session import run_folder
from codeatlas.sources import corpus, manifest, runs, snapshots

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- edges
_ENDS = """
ends AS (
  SELECT project, coalesce(nullif(from_element, ''), src_path) AS element, 0 AS i, 1 AS o FROM {edges}
  UNION ALL
  SELECT project, coalesce(nullif(to_element, ''), dst_path) AS element, 1 AS i, 0 AS o FROM {edges}),
deg AS (
  SELECT project, element, CAST(sum(i) AS BIGINT) AS inbound, CAST(sum(o) AS BIGINT) AS outbound
  FROM ends GROUP BY project, element)
"""

_HOT = """
SELECT project, rank, element, inbound, outbound, total FROM (
  SELECT project, element, inbound, outbound, inbound + outbound AS total,
         CAST(row_number() OVER (PARTITION BY project ORDER BY inbound + outbound DESC, element) AS BIGINT) AS rank
  FROM deg) WHERE rank <= 10"""


@register("hotspots", with_views("v_edges").rstrip("\n") + ",\n" + _ENDS.format(edges="v_edges") + _HOT)
def q_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    return graph.hotspots(corpus.edges(spark, sf), k=10)


@register("link_hotspots", with_views("v_links").rstrip("\n") + ",\n" + _ENDS.format(edges="v_links") + _HOT)
def q_link_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    return graph.hotspots(corpus.links(spark, sf), k=10)


# one-hop dependency filters
_EDGE_SEL = "SELECT project, edge_ord, src_path, dst_path, type, from_element, to_element FROM v_edges"


@register("deps", with_views("v_edges") + _EDGE_SEL
          + " WHERE to_element = 'red_widget_17' OR strpos(dst_path, 'red_widget_17') > 0 OR strpos(dst_path, 'b17/m2') > 0")
def q_deps(spark, sf):
    return graph.deps(corpus.edges(spark, sf), "red_widget_17", "b17/m2")


@register("calls", with_views("v_edges") + _EDGE_SEL
          + " WHERE from_element = 'blue_bolt_5' OR strpos(src_path, 'o99') > 0")
def q_calls(spark, sf):
    return graph.calls(corpus.edges(spark, sf), "blue_bolt_5", "o99")


@register("edge_summary", with_views("v_edges") + """
SELECT project, count(*) AS total,
       count(*) FILTER (WHERE type = 'import') AS imports,
       count(*) FILTER (WHERE type = 'call') AS calls,
       count(*) FILTER (WHERE type = 'extends') AS extends,
       count(*) FILTER (WHERE type = 'implements') AS implements
FROM v_edges GROUP BY project""")
def q_edge_summary(spark, sf):
    return graph.edge_summary(corpus.edges(spark, sf))


_ORDER_SQL = "edge_ord, src_path, dst_path, type, from_element NULLS FIRST, to_element NULLS FIRST"
_LABELS_SQL = """src_path || CASE WHEN coalesce(from_element, '') <> '' THEN ':' || from_element ELSE '' END AS from_label,
       dst_path || CASE WHEN coalesce(to_element, '') <> '' THEN ':' || to_element ELSE '' END AS to_label"""


@register("browse_edges", with_views("v_edges") + f"""
, m AS (SELECT *, {_LABELS_SQL} FROM v_edges
        WHERE type = 'call' AND (strpos(lower(src_path), 'gear') > 0 OR strpos(lower(dst_path), 'gear') > 0
              OR strpos(lower(coalesce(from_element, '')), 'gear') > 0 OR strpos(lower(coalesce(to_element, '')), 'gear') > 0)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY {_ORDER_SQL}) AS BIGINT) AS pos,
             count(*) OVER (PARTITION BY project) AS matches FROM m)
SELECT project, edge_ord, src_path, dst_path, type, from_element, to_element, from_label, to_label, pos,
       greatest(matches - 200, 0) AS remaining
FROM r WHERE pos <= 200""")
def q_browse_edges(spark, sf):
    return graph.browse_edges(corpus.edges(spark, sf), text="Gear", edge_type="call", limit=200)


@register("file_edges", with_views("v_edges", "v_files") + f"""
, u AS (
  SELECT f.path AS file, e.* FROM v_edges e JOIN v_files f ON e.project = f.project AND e.src_path = f.path
  UNION ALL
  SELECT f.path AS file, e.* FROM v_edges e JOIN v_files f ON e.project = f.project AND e.dst_path = f.path
  WHERE e.src_path <> f.path),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY project, file ORDER BY {_ORDER_SQL}) AS BIGINT) AS pos FROM u)
SELECT file, project, edge_ord, src_path, dst_path, type, from_element, to_element, pos FROM r WHERE pos <= 50""")
def q_file_edges(spark, sf):
    return graph.file_edges(corpus.edges(spark, sf), corpus.files(spark, sf), limit=50)


@register("element_edges", with_views("v_edges", "v_elements") + f"""
, u AS (
  SELECT l.id AS elem_id, l.path AS elem_path, l.elem_ord, e.* FROM v_edges e JOIN v_elements l ON e.project = l.project AND e.from_element = l.name
  UNION ALL
  SELECT l.id, l.path, l.elem_ord, e.* FROM v_edges e JOIN v_elements l ON e.project = l.project AND e.to_element = l.name
  WHERE e.from_element IS DISTINCT FROM l.name
  UNION ALL
  SELECT l.id, l.path, l.elem_ord, e.* FROM v_edges e JOIN v_elements l ON e.project = l.project AND e.src_path = l.path
  WHERE e.from_element IS NULL AND e.to_element IS DISTINCT FROM l.name
  UNION ALL
  SELECT l.id, l.path, l.elem_ord, e.* FROM v_edges e JOIN v_elements l ON e.project = l.project AND e.dst_path = l.path
  WHERE e.to_element IS NULL AND e.from_element IS DISTINCT FROM l.name
    AND NOT (e.from_element IS NULL AND e.src_path = l.path)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY project, elem_path, elem_ord ORDER BY {_ORDER_SQL}) AS BIGINT) AS pos FROM u)
SELECT elem_id, elem_path, elem_ord, project, edge_ord, src_path, dst_path, type, from_element, to_element, pos FROM r WHERE pos <= 50""")
def q_element_edges(spark, sf):
    return graph.element_edges(corpus.edges(spark, sf), corpus.elements(spark, sf), limit=50)


# ---------------------------------------------------------------- nodes
_API_SQL = "SELECT project, name, type, path AS file, elem_ord FROM v_elements WHERE exported OR type IN ('class', 'function', 'interface')"


@register("public_api", with_views("v_elements") + _API_SQL)
def q_public_api(spark, sf):
    return nodes.public_api(corpus.elements(spark, sf))


@register("build_summary", with_views("v_files", "v_elements") + """
SELECT f.project, f.files, e.elements FROM
  (SELECT project, count(*) AS files FROM v_files GROUP BY project) f
  JOIN (SELECT project, count(*) AS elements FROM v_elements GROUP BY project) e ON f.project = e.project""")
def q_build_summary(spark, sf):
    return nodes.build_summary(corpus.files(spark, sf), corpus.elements(spark, sf))


@register("top_files", with_views("v_files", "v_elements") + """
, per AS (SELECT f.project, f.path, count(e.name) AS elements FROM v_files f
          LEFT JOIN v_elements e ON e.project = f.project AND e.path = f.path GROUP BY f.project, f.path)
SELECT project, rank, path, elements FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY elements DESC, path) AS BIGINT) AS rank FROM per)
WHERE rank <= 10""")
def q_top_files(spark, sf):
    return nodes.top_files(corpus.files(spark, sf), corpus.elements(spark, sf), k=10)


@register("stats", with_views("v_files", "v_elements", "v_edges", "v_docs") + """
SELECT f.project, f.n AS files, e.n AS elements, g.n AS edges, d.n AS docs FROM
  (SELECT project, count(*) AS n FROM v_files GROUP BY 1) f
  JOIN (SELECT project, count(*) AS n FROM v_elements GROUP BY 1) e USING (project)
  JOIN (SELECT project, count(*) AS n FROM v_edges GROUP BY 1) g USING (project)
  JOIN (SELECT project, count(*) AS n FROM v_docs GROUP BY 1) d USING (project)""")
def q_stats(spark, sf):
    return nodes.stats(corpus.files(spark, sf), corpus.elements(spark, sf), corpus.edges(spark, sf), corpus.docs(spark, sf))


@register("arch_show_target", with_views("v_elements") + """
, hits AS (SELECT project, path, elem_ord, name FROM v_elements WHERE strpos(name, 'gizmo_4') > 0 OR strpos(id, 'gizmo_4') > 0),
fhit AS (SELECT DISTINCT project FROM v_elements WHERE strpos(path, 'gizmo_4') > 0 OR strpos(regexp_extract(path, '[^/]*$'), 'gizmo_4') > 0)
SELECT project, path, CAST(count(*) AS BIGINT) AS n_children, string_agg(name, ',' ORDER BY elem_ord) AS children
FROM hits WHERE project NOT IN (SELECT project FROM fhit) GROUP BY project, path""")
def q_arch_show_target(spark, sf):
    t = nodes.arch_show(corpus.files(spark, sf), corpus.elements(spark, sf), "gizmo_4")
    return t.select("project", "path", F.size("children").cast("long").alias("n_children"),
                    F.array_join(F.transform("children", lambda c: c["name"]), ",").alias("children"))


@register("arch_browse", with_views("v_files", "v_elements") + """
, kids AS (SELECT project, path, CAST(count(*) AS BIGINT) AS n_children, string_agg(name, ',' ORDER BY elem_ord) AS children
           FROM v_elements WHERE strpos(lower(name), 'ring_1') > 0 GROUP BY project, path)
SELECT f.project, f.path, coalesce(k.n_children, 0) AS n_children, coalesce(k.children, '') AS children
FROM v_files f LEFT JOIN kids k ON f.project = k.project AND f.path = k.path
WHERE strpos(lower(f.name), 'ring_1') > 0 OR k.n_children > 0""")
def q_arch_browse(spark, sf):
    t = nodes.arch_browse(corpus.files(spark, sf), corpus.elements(spark, sf), "RING_1")
    return t.select("project", "path", F.size("children").cast("long").alias("n_children"),
                    F.array_join(F.transform("children", lambda c: c["name"]), ",").alias("children"))


@register("known_names", with_views("v_files", "v_elements") + """
SELECT DISTINCT project, known FROM (
  SELECT project, name AS known FROM v_files UNION ALL SELECT project, path FROM v_files
  UNION ALL SELECT project, name FROM v_elements UNION ALL SELECT project, id FROM v_elements)""")
def q_known_names(spark, sf):
    return nodes.known_names(corpus.files(spark, sf), corpus.elements(spark, sf))


@register("file_exports", with_views("v_files") + """
SELECT project, path, name, coalesce(array_to_string(exports, ','), '') AS exports, CAST(coalesce(len(exports), 0) AS INTEGER) AS n_exports FROM v_files""")
def q_file_exports(spark, sf):
    f = nodes.file_exports(corpus.elements(spark, sf))
    return f.select("project", "path", "name", F.array_join("exports", ",").alias("exports"), F.size("exports").alias("n_exports"))


# ---------------------------------------------------------------- docs
@register("undocumented", with_views("v_elements", "v_docs") + f"""
SELECT a.* FROM ({_API_SQL}) a
WHERE NOT EXISTS (SELECT 1 FROM v_docs d WHERE d.project = a.project AND d.element = a.name)""")
def q_undocumented(spark, sf):
    return docops.undocumented(corpus.elements(spark, sf), corpus.docs(spark, sf))


@register("doc_coverage", with_views("v_elements", "v_docs") + f"""
, a AS ({_API_SQL}),
f AS (SELECT a.project, EXISTS (SELECT 1 FROM v_docs d WHERE d.project = a.project AND d.element = a.name) AS covered FROM a),
g AS (SELECT p.project, count(f.project) AS total, count(*) FILTER (WHERE f.covered) AS covered
      FROM (SELECT DISTINCT project FROM v_elements) p LEFT JOIN f ON f.project = p.project GROUP BY p.project)
SELECT project, total, covered,
       CASE WHEN total = 0 THEN 100 ELSE CAST(round(covered * 100.0 / total) AS BIGINT) END AS percent FROM g""")
def q_doc_coverage(spark, sf):
    return docops.doc_coverage(corpus.elements(spark, sf), corpus.docs(spark, sf))


@register("doc_type_counts", with_views("v_docs") + """
SELECT c.project, t.total, c.type, c.n FROM
  (SELECT project, type, count(*) AS n FROM v_docs GROUP BY 1, 2) c
  JOIN (SELECT project, count(*) AS total FROM v_docs GROUP BY 1) t ON c.project = t.project""")
def q_doc_type_counts(spark, sf):
    d = docops.docs_by_type(corpus.docs(spark, sf))
    return d.select("project", "total", F.explode("by_type").alias("type", "n"))


_ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"


@register("recent_docs", with_views("v_docs") + f"""
SELECT project, rank, element, type, strftime(updated_at, {_ISO}) AS updated_at FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY updated_at DESC, doc_ord) AS BIGINT) AS rank FROM v_docs)
WHERE rank <= 5""")
def q_recent_docs(spark, sf):
    r = docops.recent_docs(corpus.docs(spark, sf), k=5)
    return r.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


@register("doc_stale", with_views("v_files", "v_elements", "v_docs", "v_mtimes") + """
, known AS (SELECT DISTINCT project, known FROM (
  SELECT project, name AS known FROM v_files UNION ALL SELECT project, path FROM v_files
  UNION ALL SELECT project, name FROM v_elements UNION ALL SELECT project, id FROM v_elements)),
built AS (SELECT DISTINCT project FROM v_files),
d AS (SELECT d.project, d.doc_ord, d.element, d.path, d.updated_at, b.project IS NOT NULL AS arch,
             k.known IS NOT NULL AS is_known, m.mtime, coalesce(d.path, '') <> '' AS has_path
      FROM v_docs d
      LEFT JOIN built b ON d.project = b.project
      LEFT JOIN known k ON d.project = k.project AND d.element = k.known
      LEFT JOIN v_mtimes m ON d.project = m.project AND d.path = m.path
      WHERE d.type <> 'page'),
s AS (SELECT project, doc_ord, element,
        CASE WHEN arch AND NOT is_known THEN 'orphaned'
             WHEN has_path AND mtime IS NULL THEN 'orphaned'
             WHEN has_path AND date_trunc('millisecond', mtime) > date_trunc('millisecond', updated_at) THEN 'outdated' END AS status,
        CASE WHEN arch AND NOT is_known THEN 'element missing from architecture'
             WHEN has_path AND mtime IS NULL THEN 'file not found: ' || path
             WHEN has_path AND date_trunc('millisecond', mtime) > date_trunc('millisecond', updated_at)
               THEN 'code changed ' || strftime(mtime, '%Y-%m-%d') || ', doc updated ' || strftime(updated_at, '%Y-%m-%d') END AS reason
      FROM d)
SELECT * FROM s WHERE status IS NOT NULL""")
def q_doc_stale(spark, sf):
    return docops.doc_stale(corpus.files(spark, sf), corpus.elements(spark, sf), corpus.docs(spark, sf),
                            corpus.file_mtimes(spark, sf))


@register("doc_lookup", with_views("v_elements", "v_docs") + """
, names AS (SELECT DISTINCT project, name FROM (
    SELECT project, name FROM v_elements
    UNION ALL SELECT project, unnest(aliases) AS name FROM v_docs)),
keys AS (SELECT project, element AS name, doc_ord FROM v_docs
         UNION ALL SELECT project, unnest(aliases) AS name, doc_ord FROM v_docs),
f AS (SELECT n.project, n.name, min(k.doc_ord) AS doc_ord FROM names n
      JOIN keys k ON n.project = k.project AND n.name = k.name GROUP BY n.project, n.name)
SELECT f.project, f.name, f.doc_ord, d.element, d.type FROM f JOIN v_docs d ON f.project = d.project AND f.doc_ord = d.doc_ord""")
def q_doc_lookup(spark, sf):
    d = corpus.docs(spark, sf)
    names = corpus.elements(spark, sf).select("project", "name").unionByName(
        d.select("project", F.explode("aliases").alias("name")))
    return docops.doc_lookup(d, names).select("project", "name", "doc_ord", "element", "type")


_EXT_SQL = " OR ".join(f"ends_with(n.name, '{e}')" for e in
                       [".ts", ".tsx", ".js", ".jsx", ".py", ".rs", ".go", ".java", ".rb", ".php", ".vue", ".svelte", ".html", ".css", ".scss"])


@register("resolve_targets", with_views("v_files", "v_elements", "v_docs") + f"""
, keys AS (
  SELECT project, name, path AS r_path, 'file' AS r_type, path AS p, 0 AS child, CAST(0 AS BIGINT) AS e FROM v_files
  UNION ALL SELECT project, path, path, 'file', path, 0, 0 FROM v_files
  UNION ALL SELECT project, name, path, type, path, 1, elem_ord FROM v_elements
  UNION ALL SELECT project, id, path, type, path, 1, elem_ord FROM v_elements),
n AS (SELECT DISTINCT project, element AS name FROM v_docs),
h AS (SELECT * FROM (SELECT n.project, n.name, k.r_path, k.r_type,
        row_number() OVER (PARTITION BY n.project, n.name ORDER BY k.p, k.child, k.e) AS rn
      FROM n JOIN keys k ON n.project = k.project AND n.name = k.name) WHERE rn = 1)
SELECT n.project, n.name,
       coalesce(h.r_path, CASE WHEN {_EXT_SQL} THEN n.name ELSE '' END) AS path,
       coalesce(h.r_type, CASE WHEN {_EXT_SQL} THEN 'file' ELSE 'unknown' END) AS type
FROM n LEFT JOIN h ON n.project = h.project AND n.name = h.name""")
def q_resolve_targets(spark, sf):
    d = corpus.docs(spark, sf)
    return docops.resolve_targets(corpus.files(spark, sf), corpus.elements(spark, sf),
                                  d.select("project", F.col("element").alias("name")))


_DIR_SQL = ("CASE type WHEN 'file' THEN 'files' WHEN 'function' THEN 'functions' WHEN 'class' THEN 'classes' "
            "WHEN 'interface' THEN 'types' WHEN 'type' THEN 'types' WHEN 'enum' THEN 'types' WHEN 'variable' THEN 'variables' "
            "WHEN 'module' THEN 'modules' WHEN 'page' THEN 'pages' WHEN 'unknown' THEN 'other' ELSE 'other' END")


@register("doc_list", with_views("v_docs") + f"""
SELECT project, {_DIR_SQL} AS type_dir, doc_ord, element, type, path,
       CAST(row_number() OVER (PARTITION BY project, {_DIR_SQL} ORDER BY doc_ord) AS BIGINT) AS pos FROM v_docs""")
def q_doc_list(spark, sf):
    return docops.doc_list(corpus.docs(spark, sf))


@register("browse_docs", with_views("v_docs") + """
SELECT project, doc_ord, element, type, path FROM v_docs
WHERE strpos(lower(concat_ws(' ', type, element, CASE WHEN coalesce(path, '') = '' THEN 'free page' ELSE path END)), 'page 1') > 0
   OR strpos(lower(concat_ws(' ', type, element, CASE WHEN coalesce(path, '') = '' THEN 'free page' ELSE path END)), 'e_1') > 0""")
def q_browse_docs(spark, sf):
    d = corpus.docs(spark, sf)
    return docops.browse_docs(d, "Page 1").unionByName(
        docops.browse_docs(d, "E_1").join(docops.browse_docs(d, "Page 1").select("project", "doc_ord"), ["project", "doc_ord"], "left_anti")
    ).select("project", "doc_ord", "element", "type", "path")


@register("doc_show", with_views("v_docs") + f"""
SELECT project, doc_ord, element, path, type, markdown, {_DIR_SQL} || '/' || element || '.md' AS md_path FROM (
  SELECT *, '# ' || element || chr(10) || chr(10) || content || chr(10) AS markdown FROM v_docs) WHERE element = 'page_3'""")
def q_doc_show(spark, sf):
    d = docops.with_markdown(docops.doc_show(corpus.docs(spark, sf), "page_3"))
    return d.select("project", "doc_ord", "element", "path", "type", "markdown", "md_path")


@register("doc_show_all", with_views("v_docs", "v_elements") + """
, idx AS (SELECT * FROM v_docs WHERE doc_ord % 3 <> 0),
n AS (SELECT project, element AS name FROM v_docs UNION SELECT project, name FROM v_elements),
first AS (SELECT project, element AS name, arg_min(type, doc_ord) AS type, arg_min(path, doc_ord) AS path, arg_min(content, doc_ord) AS content FROM idx GROUP BY 1, 2),
kept AS (SELECT project, element AS name, arg_min('# ' || element || chr(10) || chr(10) || content || chr(10), """ + _DIR_SQL + """) AS md FROM v_docs GROUP BY 1, 2)
SELECT n.project, n.name AS element, CASE WHEN f.name IS NOT NULL THEN 'entry' WHEN k.name IS NOT NULL THEN 'markdown' ELSE 'not_found' END AS status,
       f.type, f.path, CASE WHEN f.name IS NOT NULL THEN f.content ELSE k.md END AS content
FROM n LEFT JOIN first f ON f.project = n.project AND f.name = n.name LEFT JOIN kept k ON k.project = n.project AND k.name = n.name""")
def q_doc_show_all(spark, sf):
    docs = corpus.docs(spark, sf)
    stored = docops.with_markdown(docs).select("project", "md_path", "markdown")
    names = docs.select("project", F.col("element").alias("name")).unionByName(corpus.elements(spark, sf).select("project", "name"))
    return docops.doc_show_all(docs.where("doc_ord % 3 <> 0"), stored, names)


# ---------------------------------------------------------------- search
def _search_sql(query: str, k: int = 25) -> str:
    S = lambda e: sql_score(query, e)
    alias = f"coalesce(list_max(list_transform(aliases, lambda a: {S('a')})), 0.0::DOUBLE)"
    return with_views("v_files", "v_elements", "v_docs") + f"""
, hits AS (
  SELECT project, name AS element, 'file' AS type, path AS location, 'code' AS source, CAST(NULL AS VARCHAR) AS signature,
         {S('path')} AS score, 0 AS s, path AS p, CAST(-1 AS BIGINT) AS o FROM v_files
  UNION ALL
  SELECT project, name, type, path || CASE WHEN coalesce(line, 0) <> 0 THEN ':' || CAST(line AS VARCHAR) ELSE '' END,
         'code', signature, greatest({S('name')}, {S("coalesce(signature, '')")} * 0.8::DOUBLE), 0, path, elem_ord FROM v_elements
  UNION ALL
  SELECT project, element, type, CASE WHEN coalesce(path, '') = '' THEN NULL ELSE path END, 'doc', NULL,
         greatest({S('element')}, {alias}, {S('content')} * 0.5::DOUBLE), 1, '', doc_ord FROM v_docs),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, element, location ORDER BY score DESC, s, p, o) AS rn
                        FROM hits WHERE score >= 0.3) WHERE rn = 1),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY score DESC, s, p, o, element, location NULLS FIRST) AS BIGINT) AS rank FROM best)
SELECT project, rank, element, type, location, source, signature, round(score, 3) AS score FROM ranked WHERE rank <= {k}"""


def _doc_search_sql(query: str) -> str:
    S = lambda e: sql_score(query, e)
    alias = f"coalesce(list_max(list_transform(aliases, lambda a: {S('a')})), 0.0::DOUBLE)"
    return with_views("v_docs") + f"""
SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY score DESC, doc_ord) AS BIGINT) AS rank,
       doc_ord, element, type, path, aliases, round(score, 3) AS score FROM (
  SELECT *, greatest({S('element')}, {alias}, {S('path')} * 0.7::DOUBLE, {S('content')} * 0.5::DOUBLE) AS score FROM v_docs)
WHERE score >= 0.3"""


_INDEXES: dict[tuple[str, str], SearchIndex] = {}


def _index(spark, sf) -> SearchIndex:
    """The stored index of the docs: the first search of a session over these tables writes it, the others read it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = SearchIndex.build(corpus.docs(spark, sf))
    return _INDEXES[key]


@register("search", _search_sql("smal widgt"))
def q_search(spark, sf):
    return search_ops.search(corpus.files(spark, sf), corpus.elements(spark, sf), corpus.docs(spark, sf), "smal widgt", k=25, index=_index(spark, sf))


@register("search_content", _search_sql("Ertion onheed"))
def q_search_content(spark, sf):
    return search_ops.search(corpus.files(spark, sf), corpus.elements(spark, sf), corpus.docs(spark, sf), "Ertion onheed", k=25, index=_index(spark, sf))


@register("doc_search", _doc_search_sql("thhe redd anat"))
def q_doc_search(spark, sf):
    return search_ops.doc_search(corpus.docs(spark, sf), "thhe redd anat", index=_index(spark, sf))


@register("doc_search_phrase", _doc_search_sql("the thatnd the"))
def q_doc_search_phrase(spark, sf):
    """A phrase that texts contain, from the stored index."""
    return search_ops.doc_search(corpus.docs(spark, sf), "the thatnd the", index=_index(spark, sf))


@register("doc_search_scan", _doc_search_sql("onheed widgt"))
def q_doc_search_scan(spark, sf):
    """Without a stored index: one pass over the texts."""
    return search_ops.doc_search(corpus.docs(spark, sf), "onheed widgt")


# ---------------------------------------------------------------- python extraction
_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _trim_sql(x: str) -> str:
    return _TRIM.format(x=x)


_PY_ELEMENTS_SQL = with_views("v_py_lines") + f"""
, w AS (SELECT *, lead(line, 1) OVER win AS n1, lead(line, 2) OVER win AS n2,
               lead(line_no, 1) OVER win AS n1_no, lead(line_no, 2) OVER win AS n2_no
        FROM v_py_lines WINDOW win AS (PARTITION BY project, path ORDER BY line_no)),
c AS (
  SELECT *, 0 AS rule, regexp_extract(line, '^def\\s+([a-zA-Z_]\\w*)\\s*\\(', 1) AS name, 'function' AS type,
         regexp_replace(regexp_replace({_trim_sql('line')}, '^def\\s+', ''), ':\\s*$', '') AS signature FROM w
  UNION ALL
  SELECT *, 1, regexp_extract(line, '^class\\s+([a-zA-Z_]\\w*)\\s*[:(]', 1), 'class',
         regexp_replace({_trim_sql('line')}, ':\\s*$', '') FROM w
  UNION ALL
  SELECT *, 2, regexp_extract(line, '^([a-zA-Z_]\\w*)\\s*[=:]', 1), 'variable', NULL FROM w
  WHERE NOT starts_with(line, 'def ') AND NOT starts_with(line, 'class ') AND NOT starts_with(line, '#')
    AND NOT starts_with(line, ' ') AND NOT starts_with(line, chr(9))
    AND regexp_extract(line, '^([a-zA-Z_]\\w*)\\s*[=:]', 1) NOT IN
        ('if', 'for', 'while', 'with', 'try', 'elif', 'else', 'except', 'finally', 'return', 'yield', 'raise', 'import', 'from')),
d AS (SELECT *, CASE WHEN n1 IS NOT NULL AND {_trim_sql('n1')} <> '' THEN {_trim_sql('n1')}
                     WHEN n2 IS NOT NULL AND {_trim_sql('n2')} <> '' THEN {_trim_sql('n2')} END AS opener,
                CASE WHEN n1 IS NOT NULL AND {_trim_sql('n1')} <> '' THEN n1_no
                     WHEN n2 IS NOT NULL AND {_trim_sql('n2')} <> '' THEN n2_no END AS o_no
      FROM c WHERE name <> ''),
q AS (SELECT *, regexp_extract(opener, '^(["'']{{3}}|["''])', 1) AS qt FROM d),
r AS (SELECT *, substr(opener, length(qt) + 1) AS rest FROM q),
nq AS (SELECT project, path, line_no,
              min(CASE WHEN strpos(line, repeat('"', 3)) > 0 THEN line_no END) OVER nw AS q1,
              min(CASE WHEN strpos(line, repeat('''', 3)) > 0 THEN line_no END) OVER nw AS q2,
              min(CASE WHEN strpos(line, '"') > 0 THEN line_no END) OVER nw AS q3,
              min(CASE WHEN strpos(line, '''') > 0 THEN line_no END) OVER nw AS q4
       FROM v_py_lines WINDOW nw AS (PARTITION BY project, path ORDER BY line_no
                                     ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
s AS (SELECT r.*, strpos(rest, qt) AS close_at,
             CASE qt WHEN repeat('"', 3) THEN nq.q1 WHEN repeat('''', 3) THEN nq.q2 WHEN '"' THEN nq.q3 WHEN '''' THEN nq.q4 END AS c_no
      FROM r LEFT JOIN nq ON nq.project = r.project AND nq.path = r.path AND nq.line_no = r.o_no),
mid AS (SELECT s.project, s.path, s.line_no, s.rule, list(l.line ORDER BY l.line_no) AS mid
        FROM s JOIN v_py_lines l ON l.project = s.project AND l.path = s.path AND l.line_no > s.o_no
             AND l.line_no < coalesce(s.c_no, 9223372036854775807)
        WHERE s.close_at = 0 AND coalesce(s.qt, '') <> '' AND s.type <> 'variable'
        GROUP BY s.project, s.path, s.line_no, s.rule),
doc AS (SELECT s.*, CASE WHEN s.type = 'variable' OR coalesce(s.qt, '') = '' THEN NULL
          WHEN s.close_at > 0 THEN nullif({_trim_sql('substr(s.rest, 1, s.close_at - 1)')}, '')
          ELSE nullif({_trim_sql("array_to_string(list_concat([s.rest], coalesce(m.mid, []), CASE WHEN s.c_no IS NULL THEN [] ELSE [split_part(cl.line, s.qt, 1)] END), chr(10))")}, '') END AS doc_comment
        FROM s LEFT JOIN mid m ON m.project = s.project AND m.path = s.path AND m.line_no = s.line_no AND m.rule = s.rule
        LEFT JOIN v_py_lines cl ON cl.project = s.project AND cl.path = s.path AND cl.line_no = s.c_no)
SELECT project, path, CAST(row_number() OVER (PARTITION BY project, path ORDER BY line_no, rule) AS BIGINT) AS elem_ord,
       path || ':' || name AS id, name, type, CAST(line_no AS INTEGER) AS line, signature, doc_comment,
       NOT starts_with(name, '_') AS exported
FROM doc"""


@register("py_elements", _PY_ELEMENTS_SQL)
def q_py_elements(spark, sf):
    return extract_python.python_elements(corpus.src_files(spark, sf))


_PY_EDGES_SQL = with_views("v_py_lines") + f"""
, t AS (SELECT *, {_trim_sql('line')} AS tl FROM v_py_lines),
fi AS (SELECT project, path, line_no, regexp_extract(tl, '^from\\s+([\\w.]+)\\s+import\\s+(.+)', 1) AS module,
              list_filter(list_transform(string_split(regexp_extract(tl, '^from\\s+([\\w.]+)\\s+import\\s+(.+)', 2), ','),
                 lambda x: string_split_regex({_trim_sql('x')}, '\\s+as\\s+')[1]), lambda x: x <> '') AS names FROM t),
fu AS (SELECT project, path, line_no, module, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS pos FROM fi WHERE module <> ''),
pi AS (SELECT project, path, line_no,
              list_filter(list_transform(string_split(regexp_extract(tl, '^import\\s+(.+)', 1), ','),
                 lambda x: string_split_regex({_trim_sql('x')}, '\\s+as\\s+')[1]), lambda x: x <> '') AS mods FROM t
       WHERE regexp_extract(tl, '^from\\s+([\\w.]+)\\s+import\\s+(.+)', 1) = '' AND regexp_extract(tl, '^import\\s+(.+)', 1) <> ''),
pu AS (SELECT project, path, line_no, unnest(mods) AS module, CAST(NULL AS VARCHAR) AS name, generate_subscripts(mods, 1) - 1 AS pos FROM pi),
imp AS (SELECT * FROM fu UNION ALL SELECT * FROM pu),
bi AS (SELECT project, path, line_no, regexp_extract(line, '^class\\s+([a-zA-Z_]\\w*)\\s*\\(([^)]+)\\)', 1) AS cls,
              list_filter(list_transform(string_split(regexp_extract(line, '^class\\s+([a-zA-Z_]\\w*)\\s*\\(([^)]+)\\)', 2), ','),
                 lambda b: {_trim_sql('b')}), lambda b: b <> '' AND b <> 'object') AS bases FROM v_py_lines),
bu AS (SELECT project, path, line_no, cls, unnest(bases) AS base, generate_subscripts(bases, 1) - 1 AS pos FROM bi WHERE cls <> ''),
mk AS (SELECT *, regexp_extract(line, '^(\\s*)def\\s+([a-zA-Z_]\\w*)\\s*\\(', 2) AS dn,
              length(regexp_extract(line, '^(\\s*)def\\s+([a-zA-Z_]\\w*)\\s*\\(', 1)) AS di FROM v_py_lines),
mk2 AS (SELECT *, CASE WHEN dn <> '' AND di IN (0, 4) THEN 1
                       WHEN length(line) > 0 AND NOT starts_with(line, ' ') AND NOT starts_with(line, chr(9)) AND dn = ''
                            AND NOT regexp_matches(line, '^class\\s+') THEN 2 END AS marker FROM mk),
sc AS (SELECT *, max(CASE WHEN marker IS NOT NULL THEN line_no END) OVER (PARTITION BY project, path ORDER BY line_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mline FROM mk2),
scoped AS (SELECT s.project, s.path, s.line_no, s.line, CASE WHEN m.marker = 1 THEN m.dn END AS caller
           FROM sc s LEFT JOIN mk2 m ON m.project = s.project AND m.path = s.path AND m.line_no = s.mline),
cl AS (SELECT project, path, line_no, caller, regexp_extract_all(line, '([a-zA-Z_][\\w.]*)\\s*\\(', 1) AS cs FROM scoped),
cu AS (SELECT project, path, line_no, caller, unnest(cs) AS callee, generate_subscripts(cs, 1) - 1 AS pos FROM cl)
SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY src_path, section, line_no, pos) AS BIGINT) AS edge_ord,
       src_path, dst_path, type, from_element, to_element FROM (
SELECT project, 0 AS section, line_no, pos, path AS src_path, replace(module, '.', '/') || '.py' AS dst_path,
       'import' AS type, CAST(NULL AS VARCHAR) AS from_element, name AS to_element FROM imp
UNION ALL
SELECT project, 1, line_no, pos, path, path, 'extends', cls, base FROM bu
UNION ALL
SELECT project, 2, line_no, pos, path, path, 'call', caller, callee FROM cu
WHERE callee NOT IN ('if', 'for', 'while', 'with', 'def', 'class', 'return', 'print', 'elif', 'except', 'lambda'))"""


@register("py_edges", _PY_EDGES_SQL)
def q_py_edges(spark, sf):
    return extract_python.python_edges(corpus.src_files(spark, sf))


# ---------------------------------------------------------------- element card
@register("card", with_views("v_files", "v_elements", "v_edges", "v_docs") + """
, n AS (SELECT DISTINCT project, name FROM (
    SELECT project, name FROM v_elements UNION ALL SELECT project, element FROM v_docs UNION ALL SELECT project, path FROM v_files)),
k AS (
  SELECT project, name AS key, 0 AS child, path AS p, CAST(0 AS BIGINT) AS e, 'file' AS type, path, CAST(NULL AS INTEGER) AS line,
         CAST(NULL AS VARCHAR) AS signature, coalesce(exports, []) AS exports, true AS is_file FROM v_files
  UNION ALL SELECT project, path, 0, path, 0, 'file', path, NULL, NULL, coalesce(exports, []), true FROM v_files WHERE path <> name
  UNION ALL SELECT project, name, 1, path, elem_ord, type, path, line, signature,
                   CASE WHEN exported THEN [name] ELSE CAST([] AS VARCHAR[]) END, false FROM v_elements
  UNION ALL SELECT project, id, 1, path, elem_ord, type, path, line, signature,
                   CASE WHEN exported THEN [name] ELSE CAST([] AS VARCHAR[]) END, false FROM v_elements WHERE id <> name),
node AS (SELECT * FROM (SELECT n.project, n.name, k.type, k.path, k.line, k.signature, k.exports, k.is_file,
                               row_number() OVER (PARTITION BY n.project, n.name ORDER BY k.child, k.p, k.e) AS rn
                        FROM n JOIN k ON n.project = k.project AND n.name = k.key) WHERE rn = 1),
kids AS (SELECT project, path, count(*) AS n_children FROM v_elements GROUP BY project, path),
dk AS (SELECT project, element AS key, doc_ord FROM v_docs UNION ALL SELECT project, unnest(aliases), doc_ord FROM v_docs),
dmin AS (SELECT n.project, n.name, min(dk.doc_ord) AS doc_ord FROM n JOIN dk ON n.project = dk.project AND n.name = dk.key GROUP BY 1, 2),
doc AS (SELECT dmin.project, dmin.name, d.type, d.path, d.content FROM dmin JOIN v_docs d ON d.project = dmin.project AND d.doc_ord = dmin.doc_ord),
md AS (SELECT project, element AS name, arg_min('# ' || element || chr(10) || chr(10) || content || chr(10), doc_ord) AS md
       FROM v_docs GROUP BY project, element),
ca AS (SELECT project, from_element AS name, count(*) AS n_calls FROM v_edges WHERE from_element IS NOT NULL GROUP BY 1, 2),
da AS (SELECT project, to_element AS name, count(*) AS n_dependents FROM v_edges WHERE to_element IS NOT NULL GROUP BY 1, 2)
SELECT n.project, n.name AS element,
       CASE WHEN node.name IS NOT NULL OR doc.name IS NOT NULL OR coalesce(ca.n_calls, 0) > 0 OR coalesce(da.n_dependents, 0) > 0
            THEN 'found' ELSE 'not_found' END AS status,
       coalesce(node.type, doc.type, 'unknown') AS type,
       coalesce(CASE WHEN coalesce(node.path, '') <> '' THEN node.path ||
                     CASE WHEN coalesce(node.line, 0) <> 0 THEN ':' || CAST(node.line AS VARCHAR) ELSE '' END END,
                nullif(doc.path, '')) AS location,
       node.signature,
       CASE WHEN len(node.exports) > 0 THEN array_to_string(node.exports, ',') END AS exports,
       CASE WHEN node.is_file THEN coalesce(kids.n_children, 0) END AS n_children,
       coalesce(ca.n_calls, 0) AS n_calls, coalesce(da.n_dependents, 0) AS n_dependents,
       coalesce(md.md, doc.content) AS documentation
FROM n LEFT JOIN node ON node.project = n.project AND node.name = n.name
LEFT JOIN kids ON node.is_file AND kids.project = n.project AND kids.path = node.path
LEFT JOIN doc ON doc.project = n.project AND doc.name = n.name
LEFT JOIN md ON md.project = n.project AND md.name = n.name
LEFT JOIN ca ON ca.project = n.project AND ca.name = n.name
LEFT JOIN da ON da.project = n.project AND da.name = n.name""")
def q_card(spark, sf):
    files, el, docs = corpus.files(spark, sf), corpus.elements(spark, sf), corpus.docs(spark, sf)
    c = card.explain(files, el, corpus.edges(spark, sf), docs, _card_names(files, el, docs))
    return c.select(
        "project", "element", "status", "type", "location", "signature",
        F.array_join("exports", ",").alias("exports"),
        F.size("children").cast("long").alias("n_children"), "n_calls", "n_dependents", "documentation")


def _card_names(files, el, docs):
    return (el.select("project", "name").unionByName(docs.select("project", F.col("element").alias("name")))
            .unionByName(files.select("project", F.col("path").alias("name"))))


_CARD_NAMES_SQL = """
, n AS (SELECT DISTINCT project, name FROM (
    SELECT project, name FROM v_elements UNION ALL SELECT project, element FROM v_docs UNION ALL SELECT project, path FROM v_files))"""


@register("card_calls", with_views("v_files", "v_elements", "v_edges", "v_docs") + _CARD_NAMES_SQL + """
SELECT e.project, n.name, coalesce(nullif(e.to_element, ''), e.dst_path) AS "to", e.type, e.edge_ord, e.src_path, e.dst_path, e.to_element
FROM v_edges e JOIN n ON n.project = e.project AND n.name = e.from_element""")
def q_card_calls(spark, sf):
    files, el, docs = corpus.files(spark, sf), corpus.elements(spark, sf), corpus.docs(spark, sf)
    return card.card_calls(corpus.edges(spark, sf), _card_names(files, el, docs))


@register("card_dependents", with_views("v_files", "v_elements", "v_edges", "v_docs") + _CARD_NAMES_SQL + """
SELECT e.project, n.name, coalesce(nullif(e.from_element, ''), e.src_path) AS "from", e.type, e.edge_ord, e.src_path, e.dst_path, e.from_element
FROM v_edges e JOIN n ON n.project = e.project AND n.name = e.to_element""")
def q_card_dependents(spark, sf):
    files, el, docs = corpus.files(spark, sf), corpus.elements(spark, sf), corpus.docs(spark, sf)
    return card.card_dependents(corpus.edges(spark, sf), _card_names(files, el, docs))


# ---------------------------------------------------------------- renderers
_EXPORTS_TAG = "CASE WHEN len(coalesce({x}, [])) > 0 THEN ' (exports: ' || array_to_string({x}, ', ') || ')' ELSE '' END"


@register("render_tree", with_views("v_files", "v_elements") + f"""
, lf AS (SELECT project, max(path) AS last FROM v_files GROUP BY project),
lc AS (SELECT project, path, max(elem_ord) AS last_el FROM v_elements GROUP BY project, path),
f AS (SELECT v.*, v.path = lf.last AS is_last FROM v_files v JOIN lf ON v.project = lf.project)
SELECT project, path, CAST(0 AS BIGINT) AS elem_ord,
       CASE WHEN is_last THEN '└── ' ELSE '├── ' END || name || {_EXPORTS_TAG.format(x='exports')} AS line FROM f
UNION ALL
SELECT e.project, e.path, e.elem_ord,
       CASE WHEN f.is_last THEN '    ' ELSE '│   ' END || CASE WHEN e.elem_ord = lc.last_el THEN '└── ' ELSE '├── ' END
       || e.name || ' [' || e.type || ']' || CASE WHEN e.exported THEN ' (exports: ' || e.name || ')' ELSE '' END
FROM v_elements e JOIN lc ON e.project = lc.project AND e.path = lc.path JOIN f ON e.project = f.project AND e.path = f.path""")
def q_render_tree(spark, sf):
    return render.render_tree(corpus.files(spark, sf), corpus.elements(spark, sf))


def _sid(x: str) -> str:
    return f"regexp_replace({x}, '[^a-zA-Z0-9_]', '_', 'g')"


def _lbl(p: str, e: str) -> str:
    return f"{p} || CASE WHEN coalesce({e}, '') <> '' THEN '.' || {e} ELSE '' END"


@register("mermaid_tree", with_views("v_files", "v_elements") + f"""
SELECT DISTINCT project, '' AS path, CAST(-1 AS BIGINT) AS elem_ord, 0 AS part, 'graph TD' AS line FROM v_files
UNION ALL SELECT project, path, 0, 0, '  ' || {_sid('path')} || '["' || name || ' (file)"]' FROM v_files
UNION ALL SELECT project, path, elem_ord, 0, '  ' || {_sid('path')} || ' --> ' || {_sid('id')} FROM v_elements
UNION ALL SELECT project, path, elem_ord, 1, '  ' || {_sid('id')} || '["' || name || ' (' || type || ')"]' FROM v_elements""")
def q_mermaid_tree(spark, sf):
    return render.render_mermaid_tree(corpus.files(spark, sf), corpus.elements(spark, sf))


_EDGE_KEYS = "project, section, edge_ord, src_path, dst_path, type, from_element, to_element, line"


@register("mermaid_edges", with_views("v_edges") + f"""
SELECT project, 1 AS section, edge_ord, src_path, dst_path, type, from_element, to_element,
       '  ' || {_sid(_lbl('src_path', 'from_element'))} || ' -->|' || type || '| ' || {_sid(_lbl('dst_path', 'to_element'))} AS line
FROM v_edges
UNION ALL SELECT DISTINCT project, 0, CAST(0 AS BIGINT), NULL, NULL, NULL, NULL, NULL, 'graph LR' FROM v_edges""")
def q_mermaid_edges(spark, sf):
    return render.render_mermaid_edges(corpus.edges(spark, sf))


def _dq(x: str) -> str:
    return f"""'"' || replace({x}, '"', '\\"') || '"'"""


@register("dot_edges", with_views("v_edges") + f"""
SELECT project, 1 AS section, edge_ord, src_path, dst_path, type, from_element, to_element,
       '  ' || {_dq(_lbl('src_path', 'from_element'))} || ' -> ' || {_dq(_lbl('dst_path', 'to_element'))}
       || ' [label="' || type || '"];' AS line
FROM v_edges
UNION ALL SELECT DISTINCT project, 0, CAST(0 AS BIGINT), NULL, NULL, NULL, NULL, NULL, 'digraph dependencies {{' FROM v_edges
UNION ALL SELECT DISTINCT project, 0, CAST(1 AS BIGINT), NULL, NULL, NULL, NULL, NULL, '  rankdir=LR;' FROM v_edges
UNION ALL SELECT DISTINCT project, 2, CAST(0 AS BIGINT), NULL, NULL, NULL, NULL, NULL, '}}' FROM v_edges""")
def q_dot_edges(spark, sf):
    return render.render_dot(corpus.edges(spark, sf))


@register("diagram_edges", with_views("v_links") + f"""
, e AS (SELECT *, {_sid(_lbl('src_path', 'from_element'))} AS f, {_sid(_lbl('dst_path', 'to_element'))} AS t FROM v_links),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, f, type, t ORDER BY {_ORDER_SQL}) AS rn FROM e) WHERE rn = 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY {_ORDER_SQL}) AS BIGINT) AS pos FROM firsts)
SELECT project, pos, f AS from_id, type, t AS to_id, '  ' || f || ' -->|' || type || '| ' || t AS line FROM r WHERE pos <= 100""")
def q_diagram_edges(spark, sf):
    return render.diagram_edges(corpus.links(spark, sf), limit=100)


# ---------------------------------------------------------------- doc maintenance
_NOW = "2025-01-01 00:00:00"
_NAME_SQL = "replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 97 AS VARCHAR)"
_CHANGES_SQL = f"""
ch AS (SELECT 'repo' || CAST(l.doc_id % 4 AS VARCHAR) AS project, l.doc_id AS change_ord, {_NAME_SQL} AS element,
              CASE WHEN l.toxic = 1 THEN '' ELSE 'quality ' || CAST(l.quality AS VARCHAR) END AS content
       FROM labels l JOIN part p ON l.doc_id = p.p_partkey)"""


def _label_changes(spark, sf):
    lab = corpus.table(spark, sf, "labels")
    p = corpus.table(spark, sf, "part")
    j = lab.join(p, lab.doc_id == p.p_partkey)
    return j.select(F.concat(F.lit("repo"), (F.col("doc_id") % 4).cast("string")).alias("project"),
                    F.col("doc_id").alias("change_ord"),
                    F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), (F.col("p_partkey") % 97).cast("string")).alias("element"),
                    F.when(F.col("toxic") == 1, F.lit("")).otherwise(F.concat(F.lit("quality "), F.col("quality").cast("string"))).alias("content"))


@register("doc_add_status", with_views("v_docs") + f""", {_CHANGES_SQL},
valid AS (SELECT * FROM ch WHERE coalesce(content, '') <> ''),
last AS (SELECT project, element, min(change_ord) AS first_ord FROM valid GROUP BY project, element),
ex AS (SELECT project, element, min(doc_ord) AS doc_ord FROM v_docs GROUP BY project, element)
SELECT ch.project, ch.change_ord, ch.element,
       CASE WHEN coalesce(ch.content, '') = '' THEN 'content_required'
            WHEN ex.doc_ord IS NOT NULL OR ch.change_ord <> last.first_ord THEN 'updated' ELSE 'added' END AS status
FROM ch LEFT JOIN ex ON ch.project = ex.project AND ch.element = ex.element
LEFT JOIN last ON ch.project = last.project AND ch.element = last.element""")
def q_doc_add_status(spark, sf):
    _, st = maintain.doc_add(corpus.files(spark, sf), corpus.elements(spark, sf), corpus.docs(spark, sf),
                             _label_changes(spark, sf), now=_NOW)
    return st


@register("doc_add_table", with_views("v_files", "v_elements", "v_docs") + f""", {_CHANGES_SQL},
valid AS (SELECT * FROM ch WHERE coalesce(content, '') <> ''),
last AS (SELECT project, element, arg_max(content, change_ord) AS content, min(change_ord) AS first_ord FROM valid GROUP BY project, element),
keys AS (
  SELECT project, name, path AS r_path, 'file' AS r_type, path AS p, 0 AS child, CAST(0 AS BIGINT) AS e FROM v_files
  UNION ALL SELECT project, path, path, 'file', path, 0, 0 FROM v_files
  UNION ALL SELECT project, name, path, type, path, 1, elem_ord FROM v_elements
  UNION ALL SELECT project, id, path, type, path, 1, elem_ord FROM v_elements),
h AS (SELECT * FROM (SELECT l.project, l.element, k.r_path, k.r_type,
        row_number() OVER (PARTITION BY l.project, l.element ORDER BY k.p, k.child, k.e) AS rn
      FROM last l JOIN keys k ON l.project = k.project AND l.element = k.name) WHERE rn = 1),
ex AS (SELECT project, element, min(doc_ord) AS doc_ord FROM v_docs GROUP BY project, element),
base AS (SELECT project, max(doc_ord) + 1 AS b FROM v_docs GROUP BY project),
rows AS (
  SELECT l.project, coalesce(ex.doc_ord, coalesce(base.b, 0) + l.first_ord) AS doc_ord, l.element,
         coalesce(h.r_path, '') AS path, coalesce(h.r_type, 'unknown') AS type, l.content,
         CAST(NULL AS VARCHAR[]) AS aliases, CAST(NULL AS VARCHAR) AS source,
         coalesce(d.created_at, TIMESTAMP '{_NOW}') AS created_at, TIMESTAMP '{_NOW}' AS updated_at
  FROM last l LEFT JOIN h ON l.project = h.project AND l.element = h.element
  LEFT JOIN ex ON l.project = ex.project AND l.element = ex.element
  LEFT JOIN v_docs d ON d.project = ex.project AND d.doc_ord = ex.doc_ord
  LEFT JOIN base ON base.project = l.project),
t AS (SELECT project, doc_ord, element, path, type, content, aliases, source, created_at, updated_at FROM v_docs
      WHERE (project, doc_ord) NOT IN (SELECT (project, doc_ord) FROM rows)
      UNION ALL SELECT * FROM rows)
SELECT project, doc_ord, element, path, type, content, aliases, source,
       strftime(created_at, {_ISO}) AS created_at, strftime(updated_at, {_ISO}) AS updated_at FROM t""")
def q_doc_add_table(spark, sf):
    nd, _ = maintain.doc_add(corpus.files(spark, sf), corpus.elements(spark, sf), corpus.docs(spark, sf),
                             _label_changes(spark, sf), now=_NOW)
    return nd.select("project", "doc_ord", "element", "path", "type", "content", "aliases", "source",
                     F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
                     F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("updated_at"))


@register("seed_counts", with_views("v_elements", "v_docs") + """
, base AS (SELECT project, element AS name, arg_max(source, doc_ord) AS src, arg_max(content, doc_ord) AS stored
           FROM v_docs GROUP BY project, element),
a AS (SELECT e.project, e.name, e.path, e.elem_ord, e.doc_comment AS c, b.src, b.stored, b.name IS NOT NULL AS ex,
             lag(e.doc_comment) OVER (PARTITION BY e.project, e.name ORDER BY e.path, e.elem_ord) AS prev
      FROM v_elements e LEFT JOIN base b ON e.project = b.project AND e.name = b.name
      WHERE coalesce(e.doc_comment, '') <> ''),
act AS (SELECT project, CASE WHEN ex AND coalesce(src <> 'auto', true) THEN 'skipped'
                             WHEN coalesce(prev, CASE WHEN src = 'auto' THEN stored END) = c THEN 'skipped'
                             ELSE 'created' END AS action FROM a)
SELECT project, count(*) FILTER (WHERE action = 'created') AS created, count(*) FILTER (WHERE action = 'skipped') AS skipped
FROM act GROUP BY project""")
def q_seed_counts(spark, sf):
    _, counts, _ = maintain.seed_docs(corpus.elements(spark, sf), corpus.docs(spark, sf), now=_NOW)
    return counts


@register("seed_table", with_views("v_elements", "v_docs") + f"""
, base AS (SELECT project, element AS name, min(doc_ord) AS doc_ord, arg_max(source, doc_ord) AS src,
                  arg_max(content, doc_ord) AS stored, arg_max(created_at, doc_ord) AS created,
                  arg_max(path, doc_ord) AS bpath, arg_max(type, doc_ord) AS btype, arg_max(aliases, doc_ord) AS baliases
           FROM v_docs GROUP BY project, element),
a AS (SELECT e.project, e.name, e.path, e.elem_ord, e.type, e.doc_comment AS c, b.src, b.stored, b.name IS NOT NULL AS ex,
             lag(e.doc_comment) OVER (PARTITION BY e.project, e.name ORDER BY e.path, e.elem_ord) AS prev
      FROM v_elements e LEFT JOIN base b ON e.project = b.project AND e.name = b.name
      WHERE coalesce(e.doc_comment, '') <> ''),
act AS (SELECT *, CASE WHEN ex AND coalesce(src <> 'auto', true) THEN 'skipped'
                       WHEN coalesce(prev, CASE WHEN src = 'auto' THEN stored END) = c THEN 'skipped'
                       ELSE 'created' END AS action FROM a),
fin AS (SELECT project, name, arg_max(path, (path, elem_ord)) AS path, arg_max(type, (path, elem_ord)) AS type,
               arg_max(c, (path, elem_ord)) AS c, min((path, elem_ord)) AS first FROM act WHERE action = 'created' GROUP BY project, name),
next AS (SELECT project, max(doc_ord) + 1 AS next FROM v_docs GROUP BY project),
fresh AS (SELECT f.*, coalesce(next, 0) + row_number() OVER (PARTITION BY f.project ORDER BY first) - 1 AS doc_ord
          FROM fin f LEFT JOIN next ON next.project = f.project WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.project = f.project AND b.name = f.name))
SELECT b.project, b.doc_ord, b.name AS element, coalesce(f.path, b.bpath) AS path, coalesce(f.type, b.btype) AS type,
       coalesce(f.c, b.stored) AS content,
       CASE WHEN f.name IS NOT NULL THEN 'auto' ELSE b.src END AS source,
       CASE WHEN f.name IS NOT NULL THEN NULL ELSE b.baliases END AS aliases,
       strftime(coalesce(b.created, TIMESTAMP '{_NOW}'), {_ISO}) AS created_at, b.doc_ord IS NULL AS is_new
FROM base b LEFT JOIN fin f ON b.project = f.project AND b.name = f.name
UNION ALL
SELECT f.project, f.doc_ord, f.name, f.path, f.type, f.c, 'auto', NULL, strftime(TIMESTAMP '{_NOW}', {_ISO}), true
FROM fresh f""")
def q_seed_table(spark, sf):
    docs = corpus.docs(spark, sf)
    nd, _, _ = maintain.seed_docs(corpus.elements(spark, sf), docs, now=_NOW)
    old = docs.groupBy("project", "element").agg(F.min("doc_ord").alias("doc_ord")).withColumn("_old", F.lit(True))
    return (nd.join(old, ["project", "element", "doc_ord"], "left")
            .select("project", "doc_ord", "element", "path", "type", "content", "source", "aliases",
                    F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
                    F.col("_old").isNull().alias("is_new")))


@register("alias_status", with_views("v_docs") + """
, ch AS (SELECT 'repo' || CAST(doc_id % 4 AS VARCHAR) AS project, doc_id AS change_ord,
                CASE WHEN quality = 1 THEN 'src' || CAST(doc_id % 20 AS VARCHAR) ELSE 'page_' || CAST(doc_id % 50 AS VARCHAR) END AS element,
                CASE WHEN toxic = 1 THEN 'flagged' ELSE 'lang_ECONOMY' END AS alias FROM labels),
keys AS (SELECT project, element AS name, doc_ord FROM v_docs UNION ALL SELECT project, unnest(aliases), doc_ord FROM v_docs),
tgt AS (SELECT ch.project, ch.element, min(k.doc_ord) AS doc_ord FROM (SELECT DISTINCT project, element FROM ch) ch
        JOIN keys k ON ch.project = k.project AND ch.element = k.name GROUP BY 1, 2),
c AS (SELECT ch.*, t.doc_ord, coalesce(d.aliases, []) AS old,
             row_number() OVER (PARTITION BY ch.project, t.doc_ord, ch.alias ORDER BY ch.change_ord) AS rn
      FROM ch LEFT JOIN tgt t ON ch.project = t.project AND ch.element = t.element
      LEFT JOIN v_docs d ON d.project = t.project AND d.doc_ord = t.doc_ord)
SELECT project, change_ord, element, alias,
       CASE WHEN doc_ord IS NULL THEN 'not_found' WHEN list_contains(old, alias) OR rn > 1 THEN 'already_exists' ELSE 'added' END AS status
FROM c""")
def q_alias_status(spark, sf):
    _, st = maintain.doc_alias(corpus.docs(spark, sf), _alias_changes(spark, sf), now=_NOW)
    return st


def _alias_changes(spark, sf):
    lab = corpus.table(spark, sf, "labels")
    return lab.select(F.concat(F.lit("repo"), (F.col("doc_id") % 4).cast("string")).alias("project"),
                      F.col("doc_id").alias("change_ord"),
                      F.when(F.col("quality") == 1, F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")))
                      .otherwise(F.concat(F.lit("page_"), (F.col("doc_id") % 50).cast("string"))).alias("element"),
                      F.when(F.col("toxic") == 1, F.lit("flagged")).otherwise(F.lit("lang_ECONOMY")).alias("alias"))


# ---------------------------------------------------------------- briefing
@register("briefing", with_views("v_files", "v_elements", "v_edges", "v_docs").rstrip("\n") + ",\n"
          + _ENDS.format(edges="v_edges") + f"""
, hot AS (SELECT project, element, inbound + outbound AS total,
                 row_number() OVER (PARTITION BY project ORDER BY inbound + outbound DESC, element) AS rank FROM deg),
per AS (SELECT f.project, f.path, count(e.name) AS n FROM v_files f
        LEFT JOIN v_elements e ON e.project = f.project AND e.path = f.path GROUP BY f.project, f.path),
tf AS (SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY n DESC, path) AS rank FROM per),
es AS (SELECT project, count(*) AS total, count(*) FILTER (WHERE type = 'import') AS imports,
              count(*) FILTER (WHERE type = 'call') AS calls, count(*) FILTER (WHERE type = 'extends') AS extends,
              count(*) FILTER (WHERE type = 'implements') AS implements FROM v_edges GROUP BY project),
rd AS (SELECT project, element, row_number() OVER (PARTITION BY project ORDER BY updated_at DESC, doc_ord) AS rank FROM v_docs)
SELECT s.project, (SELECT count(*) FROM v_files x WHERE x.project = s.project) AS files,
       (SELECT count(*) FROM v_elements x WHERE x.project = s.project) AS elements,
       es.total AS edges, es.imports, es.calls, es.extends, es.implements,
       (SELECT count(*) FROM v_docs x WHERE x.project = s.project) AS docs,
       (SELECT count(DISTINCT type) FROM v_docs x WHERE x.project = s.project) AS doc_types,
       (SELECT element FROM hot WHERE hot.project = s.project AND rank = 1) AS top_hotspot,
       (SELECT string_agg(element, ',' ORDER BY rank) FROM hot WHERE hot.project = s.project AND rank <= 10) AS hotspots,
       (SELECT string_agg(path, ',' ORDER BY rank) FROM tf WHERE tf.project = s.project AND rank <= 10) AS top_files,
       (SELECT string_agg(element, ',' ORDER BY rank) FROM rd WHERE rd.project = s.project AND rank <= 5) AS recent,
       (SELECT count(*) FROM v_elements x WHERE x.project = s.project AND (exported OR type IN ('class', 'function', 'interface'))) AS public_api_count
FROM (SELECT DISTINCT project FROM v_files) s JOIN es ON es.project = s.project""")
def q_briefing(spark, sf):
    b = briefing.context(corpus.files(spark, sf), corpus.elements(spark, sf), corpus.edges(spark, sf), corpus.docs(spark, sf))
    return b.select(
        "project", F.col("architecture.files").alias("files"), F.col("architecture.elements").alias("elements"),
        F.col("dependencies.total").alias("edges"), F.col("dependencies.imports").alias("imports"),
        F.col("dependencies.calls").alias("calls"), F.col("dependencies.extends").alias("extends"),
        F.col("dependencies.implements").alias("implements"),
        F.col("documentation.total").alias("docs"), F.size("documentation.by_type").cast("long").alias("doc_types"),
        F.col("dependencies.hotspots")[0]["element"].alias("top_hotspot"),
        F.array_join(F.transform("dependencies.hotspots", lambda s: s["element"]), ",").alias("hotspots"),
        F.array_join(F.transform("architecture.top_files", lambda s: s["path"]), ",").alias("top_files"),
        F.array_join(F.transform("documentation.recent", lambda s: s["element"]), ",").alias("recent"),
        "public_api_count")


# ---------------------------------------------------------------- benchmark run records
_RUNS_SQL = """
r AS (SELECT 'case' || CAST(user_id % 5 AS VARCHAR) AS "case",
             CASE event_type WHEN 'view' THEN 'zero' WHEN 'click' THEN 'tool' WHEN 'purchase' THEN 'terse'
                             WHEN 'signup' THEN 'terse-tool' ELSE 'other' END AS mode,
             value AS wall_s, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 1000 END AS input_tokens,
             user_id AS output_tokens, CAST(NULL AS BIGINT) AS cache_creation_tokens, event_id % 13 AS cache_read_tokens,
             value / 10 AS cost_usd, event_id AS seq, props AS result FROM events)"""


def _runs(spark, sf):
    ev = corpus.table(spark, sf, "events")
    mode = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "zero", "click", "tool", "purchase", "terse",
                                                          "signup", "terse-tool")]), F.col("event_type"))
    return ev.select(
        F.concat(F.lit("case"), (F.col("user_id") % 5).cast("string")).alias("case"),
        F.coalesce(mode, F.lit("other")).alias("mode"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("kind"),
        F.col("value").alias("wall_s"), F.lit(0).alias("rc"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("event_id") % 1000).alias("input_tokens"),
        F.col("user_id").alias("output_tokens"), F.lit(None).cast("long").alias("cache_creation_tokens"),
        (F.col("event_id") % 13).alias("cache_read_tokens"), (F.col("value") / 10).alias("cost_usd"),
        F.lit(None).cast("int").alias("num_turns"), F.col("props").alias("result"), F.col("event_id").alias("seq"))


@register("run_totals", f"WITH {_RUNS_SQL}" + """
SELECT seq, "case", mode, coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(cache_creation_tokens, 0)
       + coalesce(cache_read_tokens, 0) AS total_tokens, substr(coalesce(result, ''), 1, 280) AS result_excerpt FROM r""")
def q_run_totals(spark, sf):
    return runs.run_totals(_runs(spark, sf)).select("seq", "case", "mode", "total_tokens", "result_excerpt")


@register("run_deltas", f"WITH {_RUNS_SQL}" + """
, t AS (SELECT "case", mode, seq, wall_s, cost_usd, coalesce(input_tokens, 0) + coalesce(output_tokens, 0)
               + coalesce(cache_creation_tokens, 0) + coalesce(cache_read_tokens, 0) AS total_tokens FROM r),
l AS (SELECT "case", mode, arg_max(wall_s, seq) AS w, arg_max(total_tokens, seq) AS tt, arg_max(cost_usd, seq) AS c FROM t GROUP BY 1, 2)
SELECT o."case", o.mode, round(o.w - b.w, 2) AS d_wall_s, o.tt - b.tt AS d_total_tokens, round(o.c - b.c, 4) AS d_cost_usd
FROM l o JOIN l b ON o."case" = b."case" AND b.mode = 'zero' WHERE o.mode IN ('tool', 'terse', 'terse-tool')""")
def q_run_deltas(spark, sf):
    return runs.run_deltas(runs.run_totals(_runs(spark, sf)), baseline="zero", modes=["tool", "terse", "terse-tool"])


# ---------------------------------------------------------------- TS/JS extraction (expected rows follow from the derivation)
_TS_PARTS = """
tp AS (SELECT 'repo' || CAST(p_partkey % 4 AS VARCHAR) AS project,
              'web/b' || replace(p_brand, 'Brand#', '') || '/m' || CAST(p_size % 10 AS VARCHAR) || '.ts' AS path,
              'web/b' || replace(p_brand, 'Brand#', '') || '/m' || CAST((p_size + 3) % 10 AS VARCHAR) || '.ts' AS other, p_partkey % 3 AS shape,
              p_partkey AS pk, p_type AS t, p_size AS size, p_name,
              lower(replace(p_name, ' ', '_')) || '_' || CAST(p_partkey AS VARCHAR) AS fname,
              'C' || upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2)
                  || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)
                  || CAST(p_partkey AS VARCHAR) AS cname,
              CASE WHEN p_size % 3 = 0 THEN lower(p_type) || ' part.' END AS doc FROM part),
tr AS (SELECT *, coalesce(sum(CASE WHEN size % 3 = 0 THEN 7 ELSE 5 END) OVER (PARTITION BY project, path ORDER BY pk
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  + CASE WHEN size % 3 = 0 THEN 3 ELSE 1 END + 1 AS line,
              CASE shape WHEN 0 THEN 'Base' || CAST(size % 5 AS VARCHAR) WHEN 1 THEN 'mixin(Base' || CAST(size % 5 AS VARCHAR) || ', Q)'
                         ELSE 'Base' || CAST(size % 5 AS VARCHAR) || '<{ a: string }>' END AS base FROM tp)"""


@register("ts_elements", f"WITH {_TS_PARTS}" + """,
el AS (
  SELECT project, path, 0 AS kind, line, 0 AS dpos, fname AS name, 'function' AS type,
         fname || CASE shape WHEN 0 THEN '(x: number, y = "a,b"): number' WHEN 1 THEN '(x: Map<string, number>, cb: () => void): { d: string }'
                             ELSE '(x: T): Promise<{ a: string }>' END AS signature, doc, shape <> 2 AS exported FROM tr WHERE t IN ('ECONOMY', 'PROMO')
  UNION ALL SELECT project, path, 1, line, 0, cname, 'class', 'class ' || cname || ' extends ' || base, doc, shape <> 2 FROM tr WHERE t IN ('SMALL', 'MEDIUM')
  UNION ALL SELECT project, path, 2, line, 0, 'I' || fname, 'interface', 'interface I' || fname, CASE WHEN shape <> 1 THEN doc END, false FROM tr WHERE t = 'STANDARD'
  UNION ALL SELECT project, path, 3, line, 0, 'V' || fname, 'type', NULL, doc, false FROM tr WHERE t = 'STANDARD' AND shape = 1
  UNION ALL SELECT project, path, 5, line, 0, 'LIMIT_' || CAST(pk AS VARCHAR), 'variable', NULL, doc, shape <> 0 FROM tr WHERE t = 'LARGE'
  UNION ALL SELECT project, path, 5, line, 1, 'alt' || CAST(pk AS VARCHAR), 'variable', NULL, doc, shape <> 0 FROM tr WHERE t = 'LARGE'
  UNION ALL SELECT project, path, 5, line, 2, 'far' || CAST(pk AS VARCHAR), 'variable', NULL, doc, false FROM tr WHERE t = 'LARGE' AND shape = 0)
SELECT project, path, CAST(row_number() OVER (PARTITION BY project, path ORDER BY kind, line, dpos) AS BIGINT) AS elem_ord,
       name, type, CAST(line AS INTEGER) AS line, signature, doc AS doc_comment, exported FROM el""")
def q_ts_elements(spark, sf):
    return extract_ts.ts_elements(corpus.ts_src_files(spark, sf)).select(
        "project", "path", "elem_ord", "name", "type", "line", "signature", "doc_comment", "exported")


@register("ts_edges", f"WITH {_TS_PARTS}" + """,
ti AS (SELECT *, './m' || CAST((size + 3) % 10 AS VARCHAR) || '.js' AS spec, EXISTS (SELECT 1 FROM tp o WHERE o.project = tr.project AND o.path = tr.other) AS there FROM tr),
ed AS (
SELECT project, 0 AS section, pk, 0 AS pos, path AS src_path, CASE WHEN there THEN other ELSE spec END AS dst_path, 'import' AS type, CAST(NULL AS VARCHAR) AS from_element,
       'h' || CAST(pk AS VARCHAR) AS to_element FROM ti WHERE t IN ('PROMO', 'STANDARD')
UNION ALL SELECT project, 0, pk, 1, path, CASE WHEN there THEN other ELSE spec END, 'import', NULL, 'T' || CAST(pk AS VARCHAR) FROM ti WHERE t IN ('PROMO', 'STANDARD')
UNION ALL SELECT project, 0, pk, 0, path, 'lib' || CAST(size AS VARCHAR), 'import', NULL, 'default' FROM tr WHERE t = 'SMALL'
UNION ALL SELECT project, 1, pk, 0, path, path, 'extends', cname, base FROM tr WHERE t IN ('SMALL', 'MEDIUM')
UNION ALL SELECT project, 1, pk, 1, path, path, 'implements', cname, CASE shape WHEN 0 THEN 'I' || CAST(pk % 4 AS VARCHAR) ELSE 'I1<A, B>' END FROM tr WHERE t IN ('SMALL', 'MEDIUM') AND shape <> 2
UNION ALL SELECT project, 1, pk, 2, path, path, 'implements', cname, 'J' FROM tr WHERE t IN ('SMALL', 'MEDIUM') AND shape = 0
UNION ALL SELECT project, 2, pk, 0, path, path, 'call', fname, 'helper' || CAST(size AS VARCHAR) FROM tr WHERE t IN ('ECONOMY', 'PROMO')
UNION ALL SELECT project, 2, pk, 1, path, path, 'call', fname, 'util.scale' FROM tr WHERE t IN ('ECONOMY', 'PROMO')
UNION ALL SELECT project, 2, pk, 0, path, path, 'call', NULL, 'mixin' FROM tr WHERE t IN ('SMALL', 'MEDIUM') AND shape = 1
UNION ALL SELECT project, 2, pk, 1, path, path, 'call', NULL, 'this.run' FROM tr WHERE t IN ('SMALL', 'MEDIUM'))
SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY src_path, section, pk, pos) AS BIGINT) AS edge_ord,
       src_path, dst_path, type, from_element, to_element FROM ed""")
def q_ts_edges(spark, sf):
    return extract_ts.ts_edges(corpus.ts_src_files(spark, sf))


@register("doc_create_table", with_views("v_docs") + f"""
, ch AS (SELECT 'repo' || CAST(item_id % 4 AS VARCHAR) AS project, item_id AS change_ord,
                'page_' || CAST(item_id % 60 AS VARCHAR) AS element,
                CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'Revised: ' || text END AS content FROM benchmark),
last AS (SELECT project, element, arg_max(coalesce(nullif(content, ''), '# ' || element || chr(10) || chr(10)
                || 'Add documentation here.' || chr(10)), change_ord) AS content, min(change_ord) AS first_ord
         FROM ch GROUP BY project, element),
ex AS (SELECT project, element, min(doc_ord) AS doc_ord FROM v_docs GROUP BY project, element),
base AS (SELECT project, max(doc_ord) + 1 AS b FROM v_docs GROUP BY project),
rows AS (SELECT l.project, coalesce(ex.doc_ord, coalesce(base.b, 0) + l.first_ord) AS doc_ord, l.element, '' AS path,
                'page' AS type, l.content, CAST(NULL AS VARCHAR[]) AS aliases, CAST(NULL AS VARCHAR) AS source,
                TIMESTAMP '{_NOW}' AS created_at, TIMESTAMP '{_NOW}' AS updated_at
         FROM last l LEFT JOIN ex ON l.project = ex.project AND l.element = ex.element LEFT JOIN base ON base.project = l.project),
t AS (SELECT project, doc_ord, element, path, type, content, aliases, source, created_at, updated_at FROM v_docs
      WHERE (project, doc_ord) NOT IN (SELECT (project, doc_ord) FROM rows)
      UNION ALL SELECT * FROM rows)
SELECT project, doc_ord, element, path, type, content, aliases, source,
       strftime(created_at, {_ISO}) AS created_at, strftime(updated_at, {_ISO}) AS updated_at FROM t""")
def q_doc_create_table(spark, sf):
    b = corpus.table(spark, sf, "benchmark")
    ch = b.select(F.concat(F.lit("repo"), (F.col("item_id") % 4).cast("string")).alias("project"),
                  F.col("item_id").alias("change_ord"),
                  F.concat(F.lit("page_"), (F.col("item_id") % 60).cast("string")).alias("name"),
                  F.when(F.col("item_id") % 3 == 0, F.lit(None).cast("string"))
                  .otherwise(F.concat(F.lit("Revised: "), F.col("text"))).alias("content"))
    nd, _ = maintain.doc_create(corpus.docs(spark, sf), ch, now=_NOW)
    return nd.select("project", "doc_ord", "element", "path", "type", "content", "aliases", "source",
                     F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
                     F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("updated_at"))


@register("doc_save_table", with_views("v_docs") + f""", {_CHANGES_SQL},
last AS (SELECT project, element, arg_max(content, change_ord) AS content, min(change_ord) AS first_ord FROM ch GROUP BY project, element),
ex AS (SELECT project, element, min(doc_ord) AS doc_ord FROM v_docs GROUP BY project, element),
base AS (SELECT project, max(doc_ord) + 1 AS b FROM v_docs GROUP BY project),
upd AS (SELECT d.project, d.doc_ord, d.element, d.path, d.type, l.content, d.aliases, d.source, d.created_at,
               TIMESTAMP '{_NOW}' AS updated_at
        FROM last l JOIN ex ON l.project = ex.project AND l.element = ex.element
        JOIN v_docs d ON d.project = ex.project AND d.doc_ord = ex.doc_ord),
new AS (SELECT l.project, coalesce(base.b, 0) + l.first_ord AS doc_ord, l.element, '' AS path, 'page' AS type, l.content,
               CAST(NULL AS VARCHAR[]) AS aliases, CAST(NULL AS VARCHAR) AS source, TIMESTAMP '{_NOW}' AS created_at,
               TIMESTAMP '{_NOW}' AS updated_at
        FROM last l LEFT JOIN base ON base.project = l.project
        WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.project = l.project AND ex.element = l.element)),
rows AS (SELECT * FROM upd UNION ALL SELECT * FROM new),
t AS (SELECT project, doc_ord, element, path, type, content, aliases, source, created_at, updated_at FROM v_docs
      WHERE (project, doc_ord) NOT IN (SELECT (project, doc_ord) FROM rows)
      UNION ALL SELECT * FROM rows)
SELECT project, doc_ord, element, path, type, content, aliases, source,
       strftime(created_at, {_ISO}) AS created_at, strftime(updated_at, {_ISO}) AS updated_at FROM t""")
def q_doc_save_table(spark, sf):
    nd, _ = maintain.doc_save(corpus.docs(spark, sf), _label_changes(spark, sf), now=_NOW)
    return nd.select("project", "doc_ord", "element", "path", "type", "content", "aliases", "source",
                     F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
                     F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("updated_at"))


# ---------------------------------------------------------------- build with language dispatch
def _build_inputs(spark, sf):
    src = corpus.src_files(spark, sf).unionByName(corpus.ts_src_files(spark, sf))
    projects = spark.createDataFrame([("repo0", "python"), ("repo1", "python"), ("repo2", "typescript"), ("repo3", "javascript")],
                                     "project string, language string")
    return src, projects


_EL_COLS = "project, path, elem_ord, name, type, line, signature, doc_comment, exported"
_ED_COLS = "project, edge_ord, src_path, dst_path, type, from_element, to_element"


@register("build_elements", f"""
SELECT {_EL_COLS} FROM ({_PY_ELEMENTS_SQL}) p WHERE project IN ('repo0', 'repo1')
UNION ALL
SELECT {_EL_COLS} FROM ({ORACLE['ts_elements']}) t WHERE project IN ('repo2', 'repo3')""")
def q_build_elements(spark, sf):
    src, projects = _build_inputs(spark, sf)
    return build.build(src, projects).elements.select(*[c.strip() for c in _EL_COLS.split(",")])


@register("build_edges", f"""
SELECT {_ED_COLS} FROM ({_PY_EDGES_SQL}) p WHERE project IN ('repo0', 'repo1')
UNION ALL
SELECT {_ED_COLS} FROM ({ORACLE['ts_edges']}) t WHERE project IN ('repo2', 'repo3')""")
def q_build_edges(spark, sf):
    src, projects = _build_inputs(spark, sf)
    return build.build(src, projects).edges.select(*[c.strip() for c in _ED_COLS.split(",")])


# ---------------------------------------------------------------- manifests and projects
_PACKAGES = """
pk AS (SELECT 'sup' || CAST(s_suppkey AS VARCHAR) AS project, s_suppkey AS k, s_nationkey AS n, s_suppkey % 5 <> 0 AS has, s_suppkey % 11 = 0 AS bad FROM supplier),
man AS (SELECT project, k, CASE WHEN NOT bad THEN 'dist/m' || CAST(k % 9 AS VARCHAR) || '.js' END AS main,
               CASE WHEN bad THEN CAST([] AS VARCHAR[]) WHEN k % 2 = 0 THEN ['bin/n' || CAST(n AS VARCHAR) || '.js'] ELSE ['bin/a.js', 'bin/b.js'] END AS bins,
               CASE WHEN bad THEN '' ELSE array_to_string(list_sort(
                   [x for x in ['lib' || CAST(k % 4 AS VARCHAR) || '=1', CASE WHEN k % 7 = 0 THEN 'next=14' END,
                                CASE WHEN k % 2 = 0 THEN 'react=18' WHEN k % 7 <> 0 THEN 'react=17' END,
                                CASE WHEN k % 2 = 1 THEN 'vue=3' END] if x IS NOT NULL]), ',') END AS deps FROM pk WHERE has)"""


@register("manifests", f"WITH {_PACKAGES} SELECT project, main, array_to_string(bins, ',') AS bins, deps FROM man")
def q_manifests(spark, sf):
    m = manifest.manifests(corpus.package_files(spark, sf))
    entries = F.array_sort(F.transform(F.map_entries("deps"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return m.select("project", "main", F.array_join("bins", ",").alias("bins"), F.array_join(entries, ",").alias("deps"))


@register("detect_language", f"""WITH {_PACKAGES}
SELECT pk.project, CASE WHEN k % 3 = 0 THEN 'typescript' WHEN has THEN 'javascript' WHEN k % 3 = 1 THEN 'python' ELSE 'unknown' END AS language,
       CASE WHEN has AND NOT bad THEN CASE WHEN k % 7 = 0 THEN 'next.js' ELSE 'react' END END AS framework,
       CASE WHEN k % 4 = 0 THEN '.' ELSE 'src' END AS source_paths FROM pk""")
def q_detect_language(spark, sf):
    d = manifest.detect_language(corpus.package_files(spark, sf))
    return d.withColumn("source_paths", F.array_join("source_paths", ","))


@register("entry_points", f"""WITH {_PACKAGES}
SELECT project, 'src/index.ts' AS entry, 0 AS section, 0 AS pos FROM pk WHERE k % 4 <> 0
UNION ALL SELECT project, main, 1, 0 FROM man WHERE main IS NOT NULL
UNION ALL SELECT project, unnest(bins), 1, unnest(range(1, len(bins) + 1)) FROM man""")
def q_entry_points(spark, sf):
    src = corpus.package_files(spark, sf)
    files = src.where(F.col("path").endswith(".ts") | F.col("path").endswith(".js")).select("project", "path", basename("path").alias("name"))
    e = nodes.entry_points(files, manifest.manifests(src))
    return e.select("project", "entry", F.col("ord.s").alias("section"), F.col("ord.i").alias("pos"))


@register("alias_table", ORACLE["alias_status"].rsplit("SELECT project, change_ord, element, alias,", 1)[0].rstrip() + """,
news AS (SELECT project, doc_ord, string_agg(alias, ',' ORDER BY change_ord, alias) AS added FROM c
         WHERE doc_ord IS NOT NULL AND NOT list_contains(old, alias) AND rn = 1 GROUP BY project, doc_ord)
SELECT d.project, d.doc_ord, d.element, array_to_string(coalesce(d.aliases, []), ',') || CASE WHEN added IS NULL THEN ''
       WHEN len(coalesce(d.aliases, [])) = 0 THEN added ELSE ',' || added END AS aliases, added IS NOT NULL AS touched
FROM v_docs d LEFT JOIN news n ON n.project = d.project AND n.doc_ord = d.doc_ord""")
def q_alias_table(spark, sf):
    new, _ = maintain.doc_alias(corpus.docs(spark, sf), _alias_changes(spark, sf), now=_NOW)
    return new.select("project", "doc_ord", "element", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), ",").alias("aliases"),
                      (F.col("updated_at") == F.lit(_NOW).cast("timestamp")).alias("touched"))


@register("markdown_moves", with_views("v_docs") + """
SELECT project, doc_ord, element, 'functions/' || element || '.md' AS old_md_path, 'classes/' || element || '.md' AS new_md_path FROM v_docs WHERE type = 'function'""")
def q_markdown_moves(spark, sf):
    docs = corpus.docs(spark, sf)
    return maintain.markdown_moves(docs, docs.withColumn("type", F.when(F.col("type") == "function", F.lit("class")).otherwise(F.col("type"))))


@register("mermaid_tree_inline", with_views("v_files", "v_elements") + f"""
SELECT DISTINCT project, '' AS path, CAST(-1 AS BIGINT) AS elem_ord, 0 AS part, 'graph TD' AS line FROM v_files
UNION ALL SELECT project, path, 0, 0, '  ' || {_sid('path')} || '["' || name || '"]' FROM v_files
UNION ALL SELECT project, path, elem_ord, 0, '  ' || {_sid('path')} || ' --> ' || {_sid('id')} || '["' || name || ' (' || type || ')"]' FROM v_elements""")
def q_mermaid_tree_inline(spark, sf):
    return render.render_mermaid_tree(corpus.files(spark, sf), corpus.elements(spark, sf), inline_children=True)


@register("deps_json", with_views("v_edges") + " SELECT project, edge_ord, src_path, dst_path, type, from_element, to_element FROM v_edges")
def q_deps_json(spark, sf):
    edges = corpus.edges(spark, sf)
    return render.render_deps(edges, "json").select(F.from_json("json", edges.schema).alias("e")).select("e.*")


@register("arch_json", with_views("v_files", "v_elements") + """
, kids AS (SELECT project, path, count(*) AS n, string_agg(name, ',' ORDER BY elem_ord) AS names FROM v_elements GROUP BY project, path)
SELECT f.project, f.path, f.name, coalesce(k.n, 0) AS n_children, coalesce(k.names, '') AS children
FROM v_files f LEFT JOIN kids k ON k.project = f.project AND k.path = f.path""")
def q_arch_json(spark, sf):
    js = render.render_arch(corpus.files(spark, sf), corpus.elements(spark, sf), "json")
    tree = F.from_json("json", "project string, path string, name string, children array<struct<name:string>>")
    return js.select(tree.alias("t")).select("t.project", "t.path", "t.name", F.size("t.children").cast("long").alias("n_children"),
                                             F.array_join(F.transform("t.children", lambda c: c["name"]), ",").alias("children"))


@register("arch_show_file", with_views("v_files", "v_elements") + """
, kids AS (SELECT project, path, count(*) AS n FROM v_elements GROUP BY project, path)
SELECT f.project, f.path, coalesce(k.n, 0) AS n_children FROM v_files f LEFT JOIN kids k ON k.project = f.project AND k.path = f.path
WHERE contains(f.path, 'm7.ts') OR contains(f.name, 'm7.ts')""")
def q_arch_show_file(spark, sf):
    t = nodes.arch_show(corpus.files(spark, sf), corpus.elements(spark, sf), "m7.ts")
    return t.select("project", "path", F.size("children").cast("long").alias("n_children"))


@register("doc_store_table", ORACLE["doc_add_table"])
def q_doc_store_table(spark, sf):
    """The docs committed as a snapshot, updated there (only the touched buckets are written), and read back."""
    base = f"{run_folder(spark)}/store-{uuid.uuid4().hex}"
    first = snapshots.commit(spark, base, {"docs": corpus.docs(spark, sf)})
    changes = _label_changes(spark, sf)
    stored = snapshots.read(spark, base, "docs", first)
    new, _ = maintain.doc_add(corpus.files(spark, sf), corpus.elements(spark, sf), stored, changes, now=_NOW)
    last = snapshots.update_docs(spark, base, new, changes, since=first)
    return snapshots.read(spark, base, "docs", last).select(
        "project", "doc_ord", "element", "path", "type", "content", "aliases", "source",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
        F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("updated_at"))


# Ignore rules of the four projects: the default list, a list with a path part and a suffix, the default list, none.
@register("selected_sources", """
WITH f AS (SELECT 'repo' || CAST(p_partkey % 4 AS VARCHAR) AS project, CAST(p_partkey AS VARCHAR) AS k, (p_partkey // 4) % 8 AS place FROM part)
SELECT DISTINCT project, CASE place WHEN 0 THEN 'src/m' || k || '.ts' WHEN 1 THEN 'node_modules/m' || k || '.ts' WHEN 2 THEN 'src/dist/m' || k || '.js'
        WHEN 3 THEN 'pkg/x.egg-info/m' || k || '.py' WHEN 4 THEN 'src/m' || k || '.d.ts' WHEN 5 THEN 'pkg/distance' || k || '.py'
        WHEN 6 THEN 'gen/code/m' || k || '.mjs' WHEN 7 THEN 'src/readme' || k || '.md' END AS path,
    CASE project WHEN 'repo0' THEN 'python' WHEN 'repo1' THEN 'typescript' WHEN 'repo2' THEN 'javascript' ELSE 'unknown' END AS language
FROM f WHERE (project = 'repo0' AND place = 5) OR (project = 'repo1' AND place IN (0, 1, 2)) OR (project = 'repo2' AND place IN (0, 4, 6)) OR (project = 'repo3' AND place IN (0, 1, 2, 4, 6))""")
def q_selected_sources(spark, sf):
    rows = [("repo0", "python", None), ("repo1", "typescript", ["gen/code", "*.d.ts", "src/nothing"]), ("repo2", "javascript", None), ("repo3", None, [])]
    projects = spark.createDataFrame(rows, "project string, language string, ignore array<string>")
    return build.select_sources(corpus.mixed_paths(spark, sf), projects).select("project", "path", "language")
