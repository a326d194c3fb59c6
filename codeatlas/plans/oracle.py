"""DuckDB-runnable SQL for the driver's correctness check.

``VIEWS`` re-derives the corpus of :mod:`codeatlas.sources.corpus` in plain SQL
(independently written; the two must agree row for row). ``with_views`` emits a
``WITH`` clause holding only the views a query needs.
"""

from __future__ import annotations

_NAME = "replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 97 AS VARCHAR)"
_PATH = "'src/b' || replace(p_brand, 'Brand#', '') || '/m' || CAST(p_size AS VARCHAR) || '.ts'"
_TYPE = ("CASE p_type WHEN 'ECONOMY' THEN 'function' WHEN 'SMALL' THEN 'class' WHEN 'MEDIUM' THEN 'interface' "
         "WHEN 'PROMO' THEN 'type' WHEN 'STANDARD' THEN 'enum' WHEN 'LARGE' THEN 'variable' END")

VIEWS: dict[str, tuple[list[str], str]] = {
    "v_elements": ([], f"""
SELECT 'repo' || CAST(p_partkey % 4 AS VARCHAR) AS project,
       {_PATH} AS path,
       p_partkey AS elem_ord,
       {_PATH} || ':' || {_NAME} AS id,
       {_NAME} AS name,
       {_TYPE} AS type,
       CAST(p_partkey % 1000 + 1 AS INTEGER) AS line,
       CASE {_TYPE} WHEN 'function' THEN {_NAME} || '(size' || CAST(p_size AS VARCHAR) || ')'
                    WHEN 'class' THEN 'class ' || {_NAME}
                    WHEN 'interface' THEN 'interface ' || {_NAME} END AS signature,
       CASE WHEN p_size % 5 <> 0 THEN 'Part ' || p_name || ' of ' || p_brand END AS doc_comment,
       p_partkey % 2 = 0 AS exported
FROM part"""),
    "v_files": (["v_elements"], """
SELECT project, path, regexp_extract(path, '[^/]*$') AS name,
       list(name ORDER BY elem_ord) FILTER (WHERE exported) AS exports
FROM v_elements GROUP BY project, path"""),
    "v_mtimes": (["v_elements"], """
SELECT DISTINCT project, path,
       make_timestamp(CAST(1704067200 + CAST(regexp_extract(path, '/m([0-9]+)\\.ts$', 1) AS BIGINT) * 7 * 86400 AS BIGINT) * 1000000) AS mtime
FROM v_elements"""),
    "v_edges": ([], f"""
SELECT 'repo' || CAST(l_partkey % 4 AS VARCHAR) AS project,
       l_orderkey * 8 + l_linenumber AS edge_ord,
       'src/orders/o' || CAST(l_orderkey % 997 AS VARCHAR) || '.ts' AS src_path,
       {_PATH} AS dst_path,
       CASE l_returnflag WHEN 'A' THEN 'import' WHEN 'N' THEN 'call' WHEN 'R' THEN 'extends' END AS type,
       CASE WHEN l_linenumber % 3 <> 0 THEN replace(p_name, ' ', '_') || '_' || CAST(l_suppkey % 97 AS VARCHAR) END AS from_element,
       CASE WHEN l_linenumber % 4 <> 0 THEN {_NAME} END AS to_element
FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "v_docs": ([], f"""
SELECT 'repo' || CAST(p_partkey % 4 AS VARCHAR) AS project,
       doc_id AS doc_ord,
       CASE WHEN lang = 'de' THEN {_NAME} || '_legacy' ELSE {_NAME} END AS element,
       CASE WHEN lang = 'fr' THEN replace({_PATH}, '.ts', '.old.ts') ELSE {_PATH} END AS path,
       {_TYPE} AS type,
       text AS content,
       [source, lang || '_' || p_type] AS aliases,
       CASE WHEN lang = 'en' THEN 'auto' ELSE 'manual' END AS source,
       make_timestamp((1704067200 + doc_id * 3600) * 1000000) AS created_at,
       make_timestamp((1704067200 + doc_id * 3600 + (n_chars % 400) * 86400) * 1000000) AS updated_at
FROM part JOIN documents ON p_partkey = doc_id
UNION ALL
SELECT 'repo' || CAST(item_id % 4 AS VARCHAR), 1099511627776 + item_id, 'page_' || CAST(item_id AS VARCHAR), '', 'page',
       text, CAST([] AS VARCHAR[]), 'manual',
       make_timestamp((1704067200 + item_id * 60) * 1000000), make_timestamp((1704067200 + item_id * 60) * 1000000)
FROM benchmark"""),
    "v_src_lines": ([], r'''
SELECT project, path, p_partkey * 4 + j + 1 AS line_no, line FROM (
  SELECT 'repo' || CAST(p_partkey % 4 AS VARCHAR) AS project,
         'pkg/b' || replace(p_brand, 'Brand#', '') || '/m' || CAST(p_size % 10 AS VARCHAR) || '.py' AS path,
         p_partkey,
         unnest([0, 1, 2, 3]) AS j,
         unnest([
           CASE WHEN p_type IN ('SMALL', 'MEDIUM')
                THEN 'class ' || upper(substr(lower(replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 97 AS VARCHAR)), 1, 1))
                     || substr(lower(replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 97 AS VARCHAR)), 2)
                     || '(Base' || CAST(p_size % 5 AS VARCHAR) || '):'
                ELSE 'def ' || lower(replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 97 AS VARCHAR)) || '(x):' END,
           '    """' || lower(p_type) || ' part ' || p_name || '."""',
           '    return helper_' || CAST(p_size AS VARCHAR) || '(x) + self.scale(x)',
           CASE WHEN p_type = 'PROMO' THEN 'from lib.b' || replace(p_brand, 'Brand#', '') || ' import '
                     || lower(replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 97 AS VARCHAR)) || ', util as u'
                WHEN p_type = 'LARGE' THEN 'LIMIT_' || CAST(p_partkey AS VARCHAR) || ' = ' || CAST(p_size AS VARCHAR)
                WHEN p_type = 'STANDARD' THEN 'import os, sys'
                ELSE '' END]) AS line
  FROM part)'''),
    "v_src_files": (["v_src_lines"], """
SELECT project, path, string_agg(line, chr(10) ORDER BY line_no) AS content FROM v_src_lines GROUP BY project, path"""),
    "v_py_lines": (["v_src_files"], """
SELECT project, path, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line_no, unnest(parts) AS line
FROM (SELECT project, path, string_split(content, chr(10)) AS parts FROM v_src_files)"""),
    "v_links": ([], """
SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS project,
       page_id * 4294967296 + pos AS edge_ord, url AS src_path, href AS dst_path, 'import' AS type,
       CAST(NULL AS VARCHAR) AS from_element, CAST(NULL AS VARCHAR) AS to_element
FROM (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos
      FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))"""),
}


def with_views(*names: str) -> str:
    """``WITH`` clause for the named views and everything they depend on."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in order) + "\n"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_tokens(expr: str) -> str:
    """DuckDB twin of ``functions.score.tokenize``."""
    return (f"list_filter(regexp_split_to_array(lower(regexp_replace({expr}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), "
            f"'[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')")


def sql_score(query: str, expr: str) -> str:
    """DuckDB twin of ``functions.score.score_match`` for an ASCII query.

    DuckDB's edit distance counts UTF-8 bytes; target tokens are first mapped to
    ASCII (each other character -> '?', which never equals a query letter), making
    the byte distance equal to the code-point distance."""
    from codeatlas.functions.score import fuzzy_threshold, tokenize_py

    if not query:
        return "0.0::DOUBLE"
    q = query.lower().strip()
    qt = tokenize_py(query)
    toks = sql_tokens(expr)
    if qt:
        n = len(qt)
        exact = [f"list_contains({toks}, {_sql_str(t)})" for t in qt]
        fuzzy = [f"(NOT {e} AND len(list_filter({toks}, lambda x: levenshtein(regexp_replace(x, '[^\\x00-\\x7F]', '?', 'g'), "
                 f"{_sql_str(t)}) <= {fuzzy_threshold(t)})) > 0)" for t, e in zip(qt, exact)]
        ne = " + ".join(f"CAST({e} AS INTEGER)" for e in exact)
        nf = " + ".join(f"CAST({f} AS INTEGER)" for f in fuzzy)
        tok = (f"CASE WHEN len({toks}) = 0 THEN 0.0::DOUBLE ELSE greatest(({ne})::DOUBLE / {n}.0::DOUBLE * 0.8::DOUBLE, "
               f"({nf})::DOUBLE / {n}.0::DOUBLE * 0.6::DOUBLE) END")
    else:
        tok = "0.0::DOUBLE"
    return (f"(CASE WHEN {expr} IS NULL OR {expr} = '' THEN 0.0::DOUBLE "
            f"WHEN lower({expr}) = {_sql_str(q)} THEN 1.0::DOUBLE "
            f"WHEN strpos(lower({expr}), {_sql_str(q)}) > 0 THEN 0.9::DOUBLE ELSE {tok} END)")
