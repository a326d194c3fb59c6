"""Helpers that several operators share: input columns, native word counting, written
tables in the cluster's shared folder, and ranks within groups that may be very large."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.plans.partitioning import running_total
from codeatlas.session import run_folder

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; only a local session may lack that setting."""
    return f"{run_folder(spark)}/llm-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Write ``df`` as Parquet. Spark deletes what the job shuffled as soon as the files are there, and hands
    Python whole texts in batches of a few MB."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            conf.set(k, v)
        df.write.option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: its lineage is cut, a lost
    executor costs nothing, and the planner knows its size."""
    path = shared_folder(df.sparkSession)
    save(df, path, compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_of_helpers(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that carry their input's columns beside helpers of their own, whose names start with two
    underscores: columns of the input with such names go under others meanwhile."""
    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        free = (n for n in (f"carried{k}" for k in range(len(taken) * 2 + 1)) if n not in taken)
        names = {c: next(free) for c in docs.columns if c.startswith("__")}
        if not names:
            return stage(docs, *args, **options)
        return stage(docs.withColumnsRenamed(names), *args, **options).withColumnsRenamed({v: k for k, v in names.items()})
    return run


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """Array of the maximal runs without ASCII white space; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def rank_in_group(df: DataFrame, keys: list[str], doc_id: str, ties: list[str], out: str) -> DataFrame:
    """Add ``out``: the row's place, from 0, within its ``keys`` group in the order of (doc_id, ties), null ids first.

    A group may hold any share of all rows, and ids may be of any type and as sparse as hashes are: rows are dealt by
    ranges of (keys, doc_id, ties) and counted range by range. Rows that tie in everything get distinct places in
    some order. ``df`` is written in that order, so it should be thin."""
    return running_total(df.withColumn("__one", F.lit(1).cast("long")), keys, [doc_id, *ties], "__one", out).drop("__one")
