"""Element card for a batch of names.

The card's unbounded parts -- every outbound call and every dependent -- are rows
of their own (:func:`card_calls`, :func:`card_dependents`); :func:`explain` returns
one row per name with their numbers, so a hub element never gathers a third of the
graph into one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.text import node_key
from codeatlas.operators.docs import doc_lookup


def find_nodes(files: DataFrame, elements: DataFrame, names: DataFrame) -> DataFrame:
    """First architecture node per name (J1): files first (name, id or path) in path
    order, then elements (name or id) in (path, elem_ord) order."""
    empty = F.array().cast("array<string>")
    fk = files.select("project", F.explode(F.array_distinct(F.array("name", "path"))).alias("name"),
                      F.struct(F.lit(0).alias("child"), F.col("path").alias("p"), F.lit(0).cast("long").alias("e")).alias("o"),
                      F.struct(F.lit("file").alias("type"), F.col("path").alias("path"), F.lit(None).cast("int").alias("line"),
                               F.lit(None).cast("string").alias("signature"),
                               F.coalesce("exports", empty).alias("exports"), F.lit(True).alias("is_file")).alias("node"))
    ek = elements.select("project", F.explode(F.array_distinct(F.array("name", "id"))).alias("name"),
                         F.struct(F.lit(1).alias("child"), F.col("path").alias("p"), F.col("elem_ord").cast("long").alias("e")).alias("o"),
                         F.struct("type", "path", "line", "signature",
                                  F.when(F.col("exported"), F.array("name")).otherwise(empty).alias("exports"),
                                  F.lit(False).alias("is_file")).alias("node"))
    n = names.select("project", "name").distinct()
    return (n.join(fk.unionByName(ek), ["project", "name"])
            .groupBy("project", "name").agg(F.min_by("node", "o").alias("node")))


def card_calls(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Every outbound edge of each name, exact match on ``from_element``."""
    n = names.select("project", F.col("name").alias("from_element")).distinct()
    return edges.join(n, ["project", "from_element"]).select(
        "project", F.col("from_element").alias("name"), node_key("to_element", "dst_path").alias("to"), "type",
        *[c for c in ("edge_ord", "src_path", "dst_path", "to_element")])


def card_dependents(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Every inbound edge of each name, exact match on ``to_element``."""
    n = names.select("project", F.col("name").alias("to_element")).distinct()
    return edges.join(n, ["project", "to_element"]).select(
        "project", F.col("to_element").alias("name"), node_key("from_element", "src_path").alias("from"), "type",
        *[c for c in ("edge_ord", "src_path", "dst_path", "from_element")])


def link_counts(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Numbers of outbound and inbound edges of each name. Every edge offers its two ends; they are
    counted per name before the shuffle, and only counts meet the names."""
    ends = edges.select("project", F.inline(F.array(
        F.struct(F.col("from_element").alias("name"), F.lit(1).alias("c"), F.lit(0).alias("d")),
        F.struct(F.col("to_element").alias("name"), F.lit(0).alias("c"), F.lit(1).alias("d")))))
    per = ends.where(F.col("name").isNotNull()).groupBy("project", "name").agg(F.sum("c").alias("n_calls"), F.sum("d").alias("n_dependents"))
    return per.join(names.select("project", "name").distinct(), ["project", "name"])


def explain(files: DataFrame, elements: DataFrame, edges: DataFrame, docs: DataFrame, names: DataFrame) -> DataFrame:
    """One card per (project, name).

    type: node type, else doc type, else ``unknown``; location: ``path[:line]`` of the
    node, else the doc path (null when empty); documentation: the markdown stored
    under exactly that name, else the content of the first doc whose element or
    aliases match; status ``not_found`` when there is no node, doc, call or dependent."""
    n = names.select("project", "name").distinct()
    node = find_nodes(files, elements, n)
    # Children are gathered of the files that are asked for, not of all.
    asked = node.where("node.is_file").select("project", F.col("node.path").alias("path")).distinct()
    kids = (elements.join(asked, ["project", "path"], "left_semi").groupBy("project", "path")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("elem_ord", "name", "type", "line"))),
                             lambda s: F.struct(s["name"].alias("name"), s["type"].alias("type"), s["line"].alias("line"))).alias("children")))
    doc = doc_lookup(docs, n).select("project", "name", F.struct("type", "path", "content").alias("doc"))
    exact_md = (docs.select("project", F.col("element").alias("name"), "doc_ord", "markdown")
                .join(n, ["project", "name"]).groupBy("project", "name").agg(F.min_by("markdown", "doc_ord").alias("md")))
    links = link_counts(edges, n)
    node = node.withColumn("_kpath", F.when(F.col("node.is_file"), F.col("node.path")))
    c = (n.join(node, ["project", "name"], "left")
         .join(kids.withColumnRenamed("path", "_kpath"), ["project", "_kpath"], "left")
         .join(doc, ["project", "name"], "left")
         .join(exact_md, ["project", "name"], "left")
         .join(links, ["project", "name"], "left"))
    loc = F.when(F.coalesce(F.col("node.path"), F.lit("")) != "",
                 F.concat(F.col("node.path"), F.when(F.coalesce(F.col("node.line"), F.lit(0)) != 0,
                                                     F.concat(F.lit(":"), F.col("node.line").cast("string"))).otherwise(F.lit(""))))
    loc = F.coalesce(loc, F.nullif(F.col("doc.path"), F.lit("")))
    n_calls = F.coalesce("n_calls", F.lit(0))
    n_deps = F.coalesce("n_dependents", F.lit(0))
    found = F.col("node").isNotNull() | F.col("doc").isNotNull() | (n_calls > 0) | (n_deps > 0)
    return c.select(
        "project", F.col("name").alias("element"),
        F.when(found, F.lit("found")).otherwise(F.lit("not_found")).alias("status"),
        F.coalesce(F.col("node.type"), F.col("doc.type"), F.lit("unknown")).alias("type"),
        loc.alias("location"),
        F.col("node.signature").alias("signature"),
        F.when(F.size(F.col("node.exports")) > 0, F.col("node.exports")).alias("exports"),
        F.when(F.col("node.is_file"), F.coalesce("children", F.array().cast(kids.schema["children"].dataType))).alias("children"),
        n_calls.alias("n_calls"), n_deps.alias("n_dependents"),
        F.coalesce(F.col("md"), F.col("doc.content")).alias("documentation"))
