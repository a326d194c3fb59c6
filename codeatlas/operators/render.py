"""Renderers as DataFrames of lines.

Every renderer returns ``(project, <order columns>, line)`` rows; ordering by the
order columns gives the text. "Last sibling" flags come from a max per group (an
aggregate), not from a window over a whole project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.text import diagram_id, diagram_label, dot_quote
from codeatlas.operators.graph import edge_order_cols
from codeatlas.plans.topk import top_k




def _exports_tag(exports) -> F.Column:
    return F.when(F.size(exports) > 0, F.concat(F.lit(" (exports: "), F.array_join(exports, ", "), F.lit(")"))).otherwise(F.lit(""))


def render_tree(files: DataFrame, elements: DataFrame) -> DataFrame:
    """ASCII tree (R1): ``├── ``/``└── `` connectors; the child prefix depends on
    whether the parent file is the last one. Rows: (project, path, elem_ord, line),
    ``elem_ord`` 0 for the file line."""
    last_file = files.groupBy("project").agg(F.max("path").alias("_last"))
    f = files.join(last_file, "project").withColumn("_is_last", F.col("path") == F.col("_last"))
    file_lines = f.select("project", "path", F.lit(0).cast("long").alias("elem_ord"), F.concat(
        F.when(F.col("_is_last"), F.lit("└── ")).otherwise(F.lit("├── ")), F.col("name"),
        _exports_tag(F.coalesce("exports", F.array().cast("array<string>")))).alias("line"))
    last_child = elements.groupBy("project", "path").agg(F.max("elem_ord").alias("_last_el"))
    e = (elements.join(last_child, ["project", "path"])
         .join(f.select("project", "path", "_is_last"), ["project", "path"]))
    child_lines = e.select("project", "path", F.col("elem_ord").cast("long").alias("elem_ord"), F.concat(
        F.when(F.col("_is_last"), F.lit("    ")).otherwise(F.lit("│   ")),
        F.when(F.col("elem_ord") == F.col("_last_el"), F.lit("└── ")).otherwise(F.lit("├── ")),
        F.col("name"), F.concat(F.lit(" ["), F.col("type"), F.lit("]")),
        _exports_tag(F.when(F.col("exported"), F.array("name")).otherwise(F.array().cast("array<string>")))).alias("line"))
    return file_lines.unionByName(child_lines)


def render_mermaid_tree(files: DataFrame, elements: DataFrame, inline_children: bool = False) -> DataFrame:
    """Mermaid ``graph TD`` of files and their children (R2). Rows: (project, path,
    elem_ord, part, line); per child an edge line (part 0) then its node line (part 1).
    ``inline_children=True`` gives the browser variant (R5): file label without type,
    child label inline on the edge line."""
    fid = diagram_id("path")
    header = files.select("project").distinct().select(
        "project", F.lit("").alias("path"), F.lit(-1).cast("long").alias("elem_ord"), F.lit(0).alias("part"),
        F.lit("graph TD").alias("line"))
    flabel = F.col("name") if inline_children else F.concat(F.col("name"), F.lit(" (file)"))
    fl = files.select("project", "path", F.lit(0).cast("long").alias("elem_ord"), F.lit(0).alias("part"),
                      F.concat(F.lit("  "), fid, F.lit('["'), flabel, F.lit('"]')).alias("line"))
    cid = diagram_id("id")
    clabel = F.concat(F.lit('["'), F.col("name"), F.lit(" ("), F.col("type"), F.lit(')"]'))
    if inline_children:
        cl = elements.select("project", "path", F.col("elem_ord").cast("long"), F.lit(0).alias("part"),
                             F.concat(F.lit("  "), fid, F.lit(" --> "), cid, clabel).alias("line"))
        return header.unionByName(fl).unionByName(cl)
    edge = elements.select("project", "path", F.col("elem_ord").cast("long"), F.lit(0).alias("part"),
                           F.concat(F.lit("  "), fid, F.lit(" --> "), cid).alias("line"))
    node = elements.select("project", "path", F.col("elem_ord").cast("long"), F.lit(1).alias("part"),
                           F.concat(F.lit("  "), cid, clabel).alias("line"))
    return header.unionByName(fl).unionByName(edge).unionByName(node)


def _edge_ids(edges: DataFrame) -> DataFrame:
    return edges.withColumn("_from", diagram_id("src_path", "from_element")).withColumn("_to", diagram_id("dst_path", "to_element"))


def _with_header(edges: DataFrame, body: DataFrame, head: list[str], foot: list[str]) -> DataFrame:
    """``body`` with the diagram's first and last lines, once per project (one scan for all of them)."""
    nothing = [F.lit(None).cast("string").alias(c) for c in ("src_path", "dst_path", "type", "from_element", "to_element")]
    lines = F.array(*[F.struct(F.lit(sec).alias("section"), F.lit(i).cast("long").alias("edge_ord"), *nothing, F.lit(text).alias("line"))
                      for sec, texts in ((0, head), (2, foot)) for i, text in enumerate(texts)])
    frame = edges.select("project").distinct().select("project", F.inline(lines))
    return body.withColumn("section", F.lit(1)).select(*frame.columns).unionByName(frame)


def render_mermaid_edges(edges: DataFrame) -> DataFrame:
    """Mermaid ``graph LR``, one line per edge, no dedupe."""
    e = _edge_ids(edges)
    body = e.select("project", "edge_ord", "src_path", "dst_path", "type", "from_element", "to_element",
                    F.concat(F.lit("  "), "_from", F.lit(" -->|"), "type", F.lit("| "), "_to").alias("line"))
    return _with_header(edges, body, ["graph LR"], [])


def render_dot(edges: DataFrame) -> DataFrame:
    """Graphviz DOT, one line per edge with quoted endpoints."""
    body = edges.select("project", "edge_ord", "src_path", "dst_path", "type", "from_element", "to_element",
                        F.concat(F.lit("  "), dot_quote(diagram_label("src_path", "from_element")), F.lit(" -> "),
                                 dot_quote(diagram_label("dst_path", "to_element")),
                                 F.lit(' [label="'), F.col("type"), F.lit('"];')).alias("line"))
    return _with_header(edges, body, ["digraph dependencies {", "  rankdir=LR;"], ["}"])


def diagram_edges(edges: DataFrame, limit: int = 100) -> DataFrame:
    """Distinct diagram edges (U5, R5): one per (from id, type, to id), at its first
    occurrence in edge order, first ``limit`` per project."""
    e = _edge_ids(edges)
    first = (e.groupBy("project", "_from", "type", "_to")
             .agg(F.min(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(edge_order_cols())])).alias("o")))
    ranked = top_k(first, "project", [F.col("o")], limit, "pos")
    return ranked.select("project", "pos", F.col("_from").alias("from_id"), "type", F.col("_to").alias("to_id"),
                         F.concat(F.lit("  "), "_from", F.lit(" -->|"), "type", F.lit("| "), "_to").alias("line"))


def render_arch(files: DataFrame, elements: DataFrame, fmt: str = "json") -> DataFrame:
    """Architecture output by format (R6): ``tree``, ``mermaid`` or ``json`` (one JSON
    document per file with its children, S12)."""
    from codeatlas.operators.nodes import nest
    from codeatlas.sources.tables import to_json_lines

    if fmt == "tree":
        return render_tree(files, elements)
    if fmt == "mermaid":
        return render_mermaid_tree(files, elements)
    return to_json_lines(nest(files, elements))


def render_deps(edges: DataFrame, fmt: str = "json") -> DataFrame:
    """Dependency output by format (R6): ``mermaid``, ``dot`` or ``json`` (one JSON document per edge)."""
    from codeatlas.sources.tables import to_json_lines

    if fmt == "mermaid":
        return render_mermaid_edges(edges)
    if fmt == "dot":
        return render_dot(edges)
    return to_json_lines(edges)
