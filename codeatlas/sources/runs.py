"""Benchmark run records (B1, B2): per-run token totals and deltas against a baseline mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = ("case string, mode string, model string, kind string, wall_s double, rc int, input_tokens long, "
              "output_tokens long, cache_creation_tokens long, cache_read_tokens long, total_tokens long, "
              "cost_usd double, num_turns int, result string, result_path string, log_path string, workdir string")
EXCERPT_CHARS = 280


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """JSONL run records with an explicit schema; ``seq`` keeps file order (assigned
    before any shuffle, so it increases along the input)."""
    return spark.read.schema(RUN_SCHEMA).json(path).withColumn("seq", F.monotonically_increasing_id())


def run_totals(runs: DataFrame) -> DataFrame:
    """Missing counters count 0; total = input + output + cache creation + cache read;
    the result text is cut to 280 characters (B1)."""
    c = [F.coalesce(F.col(x), F.lit(0)).cast("long") for x in
         ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")]
    return runs.select(
        "seq", "case", "mode", "model", "kind", "wall_s", "rc", c[0].alias("input_tokens"), c[1].alias("output_tokens"),
        c[2].alias("cache_creation_tokens"), c[3].alias("cache_read_tokens"), (c[0] + c[1] + c[2] + c[3]).alias("total_tokens"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), F.coalesce("num_turns", F.lit(0)).alias("num_turns"),
        F.substring(F.coalesce("result", F.lit("")), 1, EXCERPT_CHARS).alias("result_excerpt"))


def run_deltas(runs: DataFrame, baseline: str = "zero", modes=None) -> DataFrame:
    """Per case and non-baseline mode: wall, total-token and cost difference to the
    baseline run (B2); the last record per (case, mode) wins; rows only where both
    exist. Wall rounded to 2, cost to 4 decimals."""
    last = (runs.groupBy("case", "mode")
            .agg(F.max_by(F.struct("wall_s", "total_tokens", "cost_usd"), "seq").alias("r")))
    base = last.where(F.col("mode") == baseline).select("case", F.col("r").alias("b"))
    other = last.where(F.col("mode") != baseline)
    if modes is not None:
        other = other.where(F.col("mode").isin(list(modes)))
    return other.join(base, "case").select(
        "case", "mode",
        F.round(F.col("r.wall_s") - F.col("b.wall_s"), 2).alias("d_wall_s"),
        (F.col("r.total_tokens") - F.col("b.total_tokens")).alias("d_total_tokens"),
        F.round(F.col("r.cost_usd") - F.col("b.cost_usd"), 4).alias("d_cost_usd"))
