"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies r = target / source size (r <= 3).
In the order of (size, doc_id) the expected copies are prefix-summed: document number j ends at (j + 1) * r.
With one random offset u per source, a document is emitted once per integer that its stretch
[j * r + u, (j + 1) * r + u) passes, so between floor(r) and ceil(r) times. As documents are passed in the
order of their size, the words taken differ from the target by no more than the source's longest document.

Targets are water levels: sources share all words by weight, a target stops at ``cap`` times the source's
size, and the excess is shared anew by weight among the others; the level at which the shares meet the total
is found from prefix sums over the sources ordered by cap / weight.

Work at scale: sizes of (source, size) classes are summed before any shuffle; a document's place in its
class comes from ``rank_in_group``, which splits classes of any size; no task sees a whole source. All of this runs
on thin rows, for which words are counted once. The
window over the source table (one row per source) is the only one without a partition key.

Defined results: null texts have size 0; the null source is a source of its own, last by code point; a
source without words has target 0 and nothing is taken from it; rows that repeat a doc_id count as
documents of their own; empty input gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clear_of_helpers, rank_in_group, word_count, written

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"


def _offset(source: Column, seed: str) -> Column:
    """One offset in [0, 1) per source and seed, in steps of 1/65536."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("\x00"))).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / F.lit(65536.0)


def source_targets(classes: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(source, source_size, target, offset) from (source, size, n) classes."""
    per = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1))
    whole = Window.partitionBy()
    per = per.withColumn("w", weight).withColumn("total", F.sum("source_size").over(whole))
    fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    earlier, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("total") - cap * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
    # The level if this source and all after it in the order were below their caps.
    per = per.withColumn("left", left).withColumn("left_w", F.sum("w").over(rest))
    per = per.withColumn("full", F.col("w") * F.col("left") >= cap * F.col("source_size") * F.col("left_w"))
    open_ = ~F.col("full")
    level_left, level_w = (F.max(F.when(open_, F.col(c))).over(whole) for c in ("left", "left_w"))
    target = F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("w") * level_left.cast("double") / level_w)
    return per.withColumn("target", target).select("source", "source_size", "target", _offset(F.col("source"), seed).alias("offset"))


def copies_of(thin: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """A written ``thin`` (doc_id, source, size, ...) with source_size, target and copies."""
    classes = thin.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    in_source = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    starts = classes.withColumn("first", F.coalesce(F.sum("n").over(in_source), F.lit(0)))
    targets = source_targets(classes, weights, cap, seed).withColumnRenamed("source", "t_source")
    plan = starts.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).select(
        F.col("source").alias("p_source"), F.col("size").alias("p_size"), "first", "source_size", "target", "offset")
    ranked = rank_in_group(thin, ["source", "size"], "doc_id", [], "rank")
    joined = ranked.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    end = lambda j: F.floor(j.cast("double") * rate + F.col("offset"))
    place = F.col("first") + F.col("rank")
    return joined.select(*thin.columns, "source_size", "target", (end(place + 1) - end(place)).cast("long").alias("copies"))


def mixed_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies. Words are counted once."""
    thin = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    return copies_of(thin, **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@clear_of_helpers
def emit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix: every row of ``docs`` as often as the sample takes it.

    Places are found on thin rows; texts move once, to meet their copies by id and a hash of 128 bits of all columns.
    Rows that are equal in everything take their copies together."""
    columns = [F.map_entries(F.col(f"`{f.name}`")) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in docs.schema]
    hashes = {"__a": F.xxhash64(*columns), "__b": F.xxhash64(F.lit(1), *columns)}
    thin = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *[c.alias(k) for k, c in hashes.items()]))
    taken = copies_of(thin, **options).groupBy("doc_id", "__a", "__b").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")).where("__copies > 0")
    taken = written(taken.select(F.col("doc_id").alias("__of"), F.col("__a").alias("__of_a"), F.col("__b").alias("__of_b"), "__copies", "__rows"))
    same = F.col(doc_id).eqNullSafe(F.col("__of")) & (F.col("__a") == F.col("__of_a")) & (F.col("__b") == F.col("__of_b"))
    met = lambda some: docs.withColumns(hashes).join(taken.where(some), same)
    rows = met("__rows = 1")
    if not taken.where("__rows > 1").isEmpty():
        rows = rows.unionByName(met("__rows > 1").dropDuplicates([doc_id, "__a", "__b"]))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
