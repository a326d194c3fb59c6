"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.plans.stored import stored


def place_in_group(df: DataFrame, group_cols, ord_col: str, out_col: str) -> DataFrame:
    """1-based place of each row in its group by ``ord_col``, for groups of any size and order values of any kind."""
    ranked = running_total(df.withColumn("_one", F.lit(1).cast("long")), group_cols, [ord_col], "_one", out_col)
    return ranked.withColumn(out_col, F.col(out_col) + 1).select(*df.columns, out_col)


def numbered(rows: DataFrame, group_cols, chunk_cols, order_cols, out_col: str) -> DataFrame:
    """1-based number of each row in its group, by ``chunk_cols`` and, in a chunk, by ``order_cols``.

    No task holds more than a chunk: rows are numbered in their chunk and shifted by what the chunks before hold,
    a running total over one row per chunk. ``rows`` is read twice."""
    group_cols, chunk_cols = list(group_cols), list(chunk_cols)
    keys = [*group_cols, *chunk_cols]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if len(group_cols) > 1:  # few chunks in a group, as the blocks of a file
        before = Window.partitionBy(*group_cols).orderBy(*chunk_cols).rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    else:
        sizes = running_total(sizes, group_cols, chunk_cols, "_n", "_before")
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_cols))
    out = rows.withColumn("_in", within).join(sizes.drop("_n"), keys)
    return out.withColumn(out_col, (F.col("_before") + F.col("_in")).cast("long")).drop("_before", "_in")


def lag_in_order(df: DataFrame, group_cols, order_cols, value_col: str, out_col: str) -> DataFrame:
    """``lag(value) over (partition by group order by order)`` without putting a
    whole group into one task.

    Rows are dealt by ranges of (group, order), so a group holding a third of all rows
    spreads over many tasks. The number of a row's range becomes a stored column: the
    dealt rows are stored before anything reads them, so every branch below sees
    the same ranges. Each range takes the lag of its own rows; the first row of a range
    takes the last row of the range before when that belongs to the same group. The
    table of last rows has one row per range."""
    group_cols, order_cols = list(group_cols), list(order_cols)
    keys = group_cols + order_cols
    s = stored(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    w = Window.partitionBy("_range").orderBy(*keys)
    here = F.struct(F.struct(*[F.col(c) for c in group_cols]).alias("g"), F.col(value_col).alias("v"))
    s = s.withColumns({"_rn": F.row_number().over(w), "_prev": F.lag(here).over(w)})
    last = s.groupBy("_range").agg(F.max_by(here, F.struct(*[F.col(c) for c in keys])).alias("_last"))
    carry = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_carry"))
    out = s.join(carry, "_range", "left")
    prev = F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_prev"))
    same = F.lit(True)
    for c in group_cols:
        same = same & prev["g"][c].eqNullSafe(F.col(c))
    return out.withColumn(out_col, F.when(same, prev["v"])).select(*df.columns, out_col)


def running_total(df: DataFrame, group_cols, order_cols, value_col: str, out_col: str) -> DataFrame:
    """Sum of ``value_col`` over the rows before each one, by ``order_cols`` in its group, for groups of any size.

    Rows are dealt by ranges of (group, order) and stored, so that every reader sees the same ranges; a range sums up
    its own rows, and each group starts in it from what earlier ranges hold of that group. That last table has one
    row per range and group in it, as groups follow each other in the ranges. Rows that tie get some order."""
    group_cols, order_cols = list(group_cols), list(order_cols)
    dealt = stored(df.repartitionByRange(*group_cols, *order_cols).withColumn("_total_range", F.spark_partition_id()))
    own = Window.partitionBy("_total_range", *group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_total_range", *group_cols).agg(F.sum(value_col).alias("_total_sum"))
    earlier = Window.partitionBy(*group_cols).orderBy("_total_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("_total_range").alias("_total_r"), *[F.col(c).alias(f"_total_g{i}") for i, c in enumerate(group_cols)], F.coalesce(F.sum("_total_sum").over(earlier), F.lit(0)).alias("_total_base"))
    rows = dealt.withColumn("_total_own", F.coalesce(F.sum(value_col).over(own), F.lit(0)))
    same = (F.col("_total_range") == F.col("_total_r"))
    for i, c in enumerate(group_cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_total_g{i}"))
    return rows.join(base, same).withColumn(out_col, F.col("_total_base") + F.col("_total_own")).select(*df.columns, out_col)
