"""Edge-table operators: one-hop dependency queries, degree hotspots, summaries,
neighbourhoods and browse filters (F4-F6, F10, F12-F14, A2-A4, U5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.text import edge_label, node_key
from codeatlas.plans.topk import top_k

EDGE_COLS = ["project", "edge_ord", "src_path", "dst_path", "type", "from_element", "to_element"]


def _any_of(elements, el_col: str, path_col: str) -> F.Column:
    # plain OR of equality / substring tests: a WHERE drops NULL like false, and this
    # form pushes down to the Parquet scan (EqualTo / StringContains)
    cond = None
    for x in elements:
        c = (F.col(el_col) == F.lit(x)) | F.col(path_col).contains(x)
        cond = c if cond is None else cond | c
    return cond if cond is not None else F.lit(False)


def deps(edges: DataFrame, *elements: str) -> DataFrame:
    """Reverse dependencies (F4): edges whose target element equals a name or whose
    target path contains it. Calls point at their own file, so a file name also
    returns that file's internal calls. Several names = one pass, union of matches."""
    return edges.where(_any_of(elements, "to_element", "dst_path"))


def calls(edges: DataFrame, *elements: str) -> DataFrame:
    """Forward dependencies (F5): source element equal, or source path containing it."""
    return edges.where(_any_of(elements, "from_element", "src_path"))


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree per graph node and project in one pass.

    Each edge emits its two endpoints; a hash aggregate with map-side partial
    sums then handles hub nodes of any size."""
    sides = F.array(
        F.struct(node_key("from_element", "src_path").alias("element"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(node_key("to_element", "dst_path").alias("element"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )
    return (edges.select("project", F.inline(sides))
            .groupBy("project", "element")
            .agg(F.sum("i").cast("long").alias("inbound"), F.sum("o").cast("long").alias("outbound")))


def hotspots(edges: DataFrame, k: int = 10) -> DataFrame:
    """Top-``k`` nodes per project by in+out degree (A4, T3); ties by name."""
    d = degrees(edges).withColumn("total", F.col("inbound") + F.col("outbound"))
    return top_k(d, "project", [F.col("total").desc(), F.col("element")], k).select(
        "project", "rank", "element", "inbound", "outbound", "total")


def edge_summary(edges: DataFrame) -> DataFrame:
    """Per project: total, import, call, extends and implements counts."""
    return edges.groupBy("project").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("type") == "import").alias("imports"),
        F.count_if(F.col("type") == "call").alias("calls"),
        F.count_if(F.col("type") == "extends").alias("extends"),
        F.count_if(F.col("type") == "implements").alias("implements"),
    )


def browse_edges(edges: DataFrame, text: str | None = None, edge_type: str | None = None,
                 limit: int | None = 200) -> DataFrame:
    """Edge browser (F10): optional type tab and case-insensitive substring over the
    four endpoint columns; first ``limit`` rows per project in edge order, with the
    true number of further matches in ``remaining``."""
    df = edges
    if edge_type and edge_type != "all":
        df = df.where(F.col("type") == F.lit(edge_type))
    if text:
        f = text.lower()
        df = df.where(
            F.lower("src_path").contains(f) | F.lower("dst_path").contains(f)
            | F.lower(F.coalesce("from_element", F.lit(""))).contains(f)
            | F.lower(F.coalesce("to_element", F.lit(""))).contains(f))
    df = df.select(*EDGE_COLS,
                   edge_label("src_path", "from_element").alias("from_label"),
                   edge_label("dst_path", "to_element").alias("to_label"))
    if limit is None:
        return df
    ranked = top_k(df, "project", edge_order(), limit, "pos")
    counts = df.groupBy("project").agg(F.count(F.lit(1)).alias("matches"))
    return (ranked.join(counts, "project")
            .withColumn("remaining", F.greatest(F.col("matches") - F.lit(limit), F.lit(0))).drop("matches"))


def file_edges(edges: DataFrame, paths: DataFrame, limit: int | None = 50) -> DataFrame:
    """Neighbourhood of many files at once (F12): edges with ``src_path = path`` or
    ``dst_path = path``. Each edge offers its two endpoint paths as keys; one equi-join
    on (project, key) replaces an OR join, and an internal edge (src = dst) is kept
    once, so duplicate edges keep their multiplicity."""
    keys = edges.select(*EDGE_COLS, F.inline(F.array(
        F.struct(F.lit(1).alias("kind"), F.col("src_path").alias("key")),
        F.struct(F.lit(2).alias("kind"), F.when(F.col("dst_path") != F.col("src_path"), F.col("dst_path")).alias("key")))))
    p = paths.select("project", F.col("path").alias("key"), F.col("path").alias("file"))
    both = keys.where(F.col("key").isNotNull()).join(p, ["project", "key"]).select("file", *EDGE_COLS)
    if limit is None:
        return both
    return top_k(both, ["project", "file"], edge_order(), limit, "pos")


def element_edges(edges: DataFrame, elems: DataFrame, limit: int | None = 50) -> DataFrame:
    """Neighbourhood of many elements, one per (project, path, elem_ord) -- ids may repeat -- (F13): ``from_element = name``, ``to_element = name``,
    or a file-level edge (null element) on the element's own path; each edge listed
    once per element, first ``limit`` in edge order.

    Name matches depend only on (project, name) and path matches only on
    (project, path), so with a limit each side is first cut to its own top ``limit``,
    one sorted list per key. Elements meet the two lists, never an edge as a row: what a
    task sorts are a bounded share of the edges, or elements. The cut is exact: an edge in
    an element's top ``limit`` is in the top ``limit`` of its name side or of its path side."""
    fe, te = F.col("from_element"), F.col("to_element")
    ends_n = [fe, F.when(~F.coalesce(fe == te, F.lit(False)), te)]
    ends_p = [F.when(fe.isNull(), F.col("src_path")),
              F.when(te.isNull() & ~(fe.isNull() & (F.col("src_path") == F.col("dst_path"))), F.col("dst_path"))]
    own = elems.select("project", F.col("id").alias("elem_id"), F.col("path").alias("elem_path"), "elem_ord", "name")
    elem = ["elem_id", "elem_path", "elem_ord"]
    # a path-side edge whose from/to element is the element's own name is already on the name side
    on_name = lambda f, t: F.coalesce(f == F.col("name"), F.lit(False)) | F.coalesce(t == F.col("name"), F.lit(False))
    if limit is None:
        hits_n = _by_end(edges, ends_n, "name").join(own, ["project", "name"])
        hits_p = _by_end(edges, ends_p, "elem_path").join(own, ["project", "elem_path"]).where(~on_name(fe, te))
        return hits_n.select(*elem, *EDGE_COLS).unionByName(hits_p.select(*elem, *EDGE_COLS))
    names, paths = _first_edges(edges, ends_n, "name", limit), _first_edges(edges, ends_p, "elem_path", limit)

    def hits(some: DataFrame) -> DataFrame:
        # the lists are the hashed sides: rows that carry a list are not sorted for the join
        both = (some.join(names.hint("shuffle_hash"), ["project", "name"], "left")
                .join(paths.hint("shuffle_hash"), ["project", "elem_path"], "left"))
        none = F.array().cast(names.schema["name_edges"].dataType)
        rest = F.filter(F.coalesce("elem_path_edges", none), lambda e: ~on_name(e["from_element"], e["to_element"]))
        return both.select("project", *elem, F.slice(F.sort_array(F.concat(F.coalesce("name_edges", none), rest)), 1, limit).alias("_e"))

    # elements given more than once share one limit
    keys = ["project", "elem_path", "elem_ord"]
    again = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_{c}") for c in keys])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = [*elem, *EDGE_COLS, "pos"]
    one = (hits(own.join(again, same, "left_anti")).select("project", *elem, F.posexplode("_e").alias("_at", "e"))
           .select("project", *elem, "e.*", (F.col("_at") + 1).cast("long").alias("pos")))
    more = hits(own.join(again, same, "left_semi")).select("project", *elem, F.inline("_e"))
    return one.select(*out).unionByName(top_k(more, keys, edge_order(), limit, "pos").select(*out))


def _by_end(edges: DataFrame, ends, key: str) -> DataFrame:
    """Each edge under each of its ``ends`` that isn't null, as the column ``key``; ``_end`` numbers them."""
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("_end"), x.alias(key)) for i, x in enumerate(ends)])
    return edges.select(*EDGE_COLS, F.inline(keys)).where(F.col(key).isNotNull())


def _first_edges(edges: DataFrame, ends, key: str, limit: int) -> DataFrame:
    """One row per (project, ``key``): the first ``limit`` edges with that end in edge order, as the array ``<key>_edges``.

    Edges are dealt by key and end into pieces of a size that adaptive execution bounds -- a hub takes several -- and
    each piece is cut before the keys are brought together, so no task sorts more than a piece or the cut rows."""
    dealt = _by_end(edges, ends, key).hint("rebalance", "project", key, "_end")
    cut = top_k(dealt, ["project", key], edge_order(), limit, "_r")
    return (cut.groupBy("project", key)
            .agg(F.sort_array(F.collect_list(F.struct(*edge_order_cols()))).alias(f"{key}_edges")))


def edge_order_cols():
    """The :func:`edge_order` keys as plain columns (struct comparison puts nulls first)."""
    return [F.col(c) for c in ("edge_ord", "src_path", "dst_path", "type", "from_element", "to_element")]


def edge_order():
    """Total order on edge rows: ``edge_ord`` then every endpoint column."""
    return [F.col("edge_ord"), F.col("src_path"), F.col("dst_path"), F.col("type"),
            F.col("from_element").asc_nulls_first(), F.col("to_element").asc_nulls_first()]
