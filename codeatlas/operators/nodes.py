"""Files / elements operators: nesting, target and browse filters, public API,
summaries, entry points and the known-name set (F3, F7, F9, A1, A5, A9, A11, U3, U4, X17).

Files are ordered by ``path`` within a project (the walk order); elements by
``elem_ord`` within a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.text import stem
from codeatlas.plans.topk import top_k

# Public-API types and entry-point file stems.
API_TYPES = ["class", "function", "interface"]
ENTRY_STEMS = ["index", "main", "app", "cli", "server", "mod"]

CHILD_FIELDS = ["elem_ord", "id", "name", "type", "path", "line", "signature", "doc_comment", "exported"]


def child_struct() -> F.Column:
    return F.struct(*[F.col(c) for c in CHILD_FIELDS],
                    F.when(F.col("exported"), F.array(F.col("name"))).otherwise(F.array().cast("array<string>")).alias("exports"))


def nest(files: DataFrame, elements: DataFrame) -> DataFrame:
    """One row per file with its ordered ``children`` array (the two-level tree, X17)."""
    kids = (elements.groupBy("project", "path")
            .agg(F.sort_array(F.collect_list(child_struct())).alias("children")))
    return (files.join(kids, ["project", "path"], "left")
            .select("project", "path", "name", F.lit("file").alias("type"), "exports",
                    F.coalesce("children", F.array().cast(kids.schema["children"].dataType)).alias("children")))


def file_exports(elements: DataFrame) -> DataFrame:
    """Files table from elements: ordered concatenation of exported names."""
    return (elements.groupBy("project", "path")
            .agg(F.sort_array(F.collect_list(F.when(F.col("exported"), F.struct("elem_ord", "name")))).alias("_x"))
            .select("project", "path", F.element_at(F.split("path", "/"), -1).alias("name"),
                    F.transform("_x", lambda s: s["name"]).alias("exports")))


def arch_show(files: DataFrame, elements: DataFrame, target: str | None = None) -> DataFrame:
    """Architecture filter (F3). Per project: files whose path or name contains
    ``target`` (case-sensitive); only when no file of the project matches, files having
    a child whose name or id contains it, with ``children`` narrowed to those.

    Files and elements are filtered before anything is nested, so only what is shown is gathered."""
    if not target:
        return nest(files, elements)
    t = F.lit(target)
    by_file = files.where(F.col("path").contains(t) | F.col("name").contains(t))
    whole = nest(by_file, elements.join(by_file.select("project", "path"), ["project", "path"], "left_semi"))
    hits = elements.where(F.col("name").contains(t) | F.col("id").contains(t))
    hits = hits.join(by_file.select("project").distinct(), "project", "left_anti")
    return whole.unionByName(nest(files.join(hits.select("project", "path"), ["project", "path"], "left_semi"), hits))


def arch_browse(files: DataFrame, elements: DataFrame, text: str | None = None) -> DataFrame:
    """Case-insensitive tree filter (F9): a file stays if its name or a child's name
    contains the text; children are always narrowed by name, before they are nested."""
    if not text:
        return nest(files, elements)
    f = F.lit(text.lower())
    hits = elements.where(F.lower("name").contains(f))
    tree = nest(files, hits)
    return tree.where(F.lower("name").contains(f) | (F.size("children") > 0))


def public_api(elements: DataFrame) -> DataFrame:
    """Exported elements plus every class / function / interface."""
    return elements.where(F.col("exported") | F.col("type").isin(API_TYPES)).select(
        "project", "name", "type", F.col("path").alias("file"), "elem_ord")


def build_summary(files: DataFrame, elements: DataFrame) -> DataFrame:
    """Files and elements per project (A1)."""
    f = files.groupBy("project").agg(F.count(F.lit(1)).alias("files"))
    e = elements.groupBy("project").agg(F.count(F.lit(1)).alias("elements"))
    return f.join(e, "project", "full").select("project", F.coalesce("files", F.lit(0)).alias("files"),
                                               F.coalesce("elements", F.lit(0)).alias("elements"))


def elements_per_file(files: DataFrame, elements: DataFrame) -> DataFrame:
    per = elements.groupBy("project", "path").agg(F.count(F.lit(1)).alias("elements"))
    return files.select("project", "path").join(per, ["project", "path"], "left").select(
        "project", "path", F.coalesce("elements", F.lit(0)).alias("elements"))


def top_files(files: DataFrame, elements: DataFrame, k: int = 10) -> DataFrame:
    """Largest files by element count, zero included, top ``k`` per project (A5)."""
    return top_k(elements_per_file(files, elements), "project",
                 [F.col("elements").desc(), F.col("path")], k).select("project", "rank", "path", "elements")


def stats(files: DataFrame, elements: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Header counts per project: files, elements, edges, docs."""
    parts = [t.groupBy("project").agg(F.count(F.lit(1)).alias(n))
             for t, n in ((files, "files"), (elements, "elements"), (edges, "edges"), (docs, "docs"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "project", "full")
    return out.select("project", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "elements", "edges", "docs")])


def entry_points(files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """Entry points (U3): files whose stem is a known entry name, then the manifest
    ``main`` and ``bin`` values; distinct, in first-seen order (``ord``)."""
    f = files.where(stem("name").isin(ENTRY_STEMS)).select(
        "project", F.col("path").alias("entry"), F.struct(F.lit(0).alias("s"), F.col("path").alias("k"), F.lit(0).alias("i")).alias("ord"))
    if manifests is not None:
        m = manifests.select("project", F.posexplode(F.concat(
            F.when(F.col("main").isNotNull(), F.array("main")).otherwise(F.array().cast("array<string>")),
            F.coalesce("bins", F.array().cast("array<string>")))).alias("i", "entry"))
        m = m.select("project", "entry", F.struct(F.lit(1).alias("s"), F.lit("").alias("k"), F.col("i")).alias("ord"))
        f = f.unionByName(m)
    return f.groupBy("project", "entry").agg(F.min("ord").alias("ord"))


def known_names(files: DataFrame, elements: DataFrame) -> DataFrame:
    """Every name a doc may refer to (U4): file name and id (= path), element name and id."""
    a = files.select("project", F.explode(F.array("name", "path")).alias("known"))
    b = elements.select("project", F.explode(F.array("name", "id")).alias("known"))
    return a.unionByName(b).distinct()
