"""A snapshot log over stored tables.

A commit writes its tables to folders of their own and then adds one entry to the log that names, for every table,
the folders that make it up, and when it was generated. Entries are numbered; adding one fails if the number is taken, so
of two writers that started from the same snapshot one succeeds and the other gets a ``ConflictError`` (and may start
anew from the snapshot that is there now). A reader takes one entry and sees the tables of that commit together, whatever
is being written meanwhile. Data folders are never changed.

``docs`` are dealt to buckets by (project, element), a folder each. An update writes the buckets that its changes touch
and names the others where they are, so what is written follows the batch and not the table.
"""

from __future__ import annotations

import datetime
import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.sources.tables import SCHEMAS

BUCKETS = 64
_LOG, _DATA = "log", "data"


class ConflictError(RuntimeError):
    """Another writer has committed since the snapshot that this one started from."""


class Snapshot(NamedTuple):
    version: int
    generated_at: datetime.datetime | None
    tables: dict[str, dict[str, str]]  # name -> bucket -> folder


NONE = Snapshot(0, None, {})


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, base: str) -> list[int]:
    fs, log = _fs(spark, base), _path(spark, f"{base}/{_LOG}")
    if not fs.exists(log):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(log))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def snapshot(spark: SparkSession, base: str, version: int | None = None) -> Snapshot:
    """The last snapshot, or a given one; ``NONE`` if nothing was committed."""
    there = versions(spark, base)
    if not there:
        return NONE
    number = there[-1] if version is None else version
    text = spark.read.text(f"{base}/{_LOG}/{number:020d}.json", wholetext=True).first()[0]
    entry = json.loads(text)
    return Snapshot(number, datetime.datetime.fromisoformat(entry["generated_at"]), entry["tables"])


def read(spark: SparkSession, base: str, name: str, of: Snapshot | None = None) -> DataFrame:
    """A table of a snapshot, by default the last; a table that it doesn't have is empty."""
    of = snapshot(spark, base) if of is None else of
    folders = sorted(set(of.tables.get(name, {}).values()))
    if not folders:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(*[f"{base}/{f}" for f in folders])


def _add_entry(spark: SparkSession, base: str, version: int, generated_at: datetime.datetime, tables: dict) -> Snapshot:
    """Write the entry under another name, then give it its number if that is free."""
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, base).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    fs = _fs(spark, base)
    fs.mkdirs(_path(spark, f"{base}/{_LOG}"))
    draft = _path(spark, f"{base}/{_LOG}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(json.dumps({"generated_at": generated_at.isoformat(), "tables": tables}).encode())
    out.close()
    try:
        files.rename(draft, _path(spark, f"{base}/{_LOG}/{version:020d}.json"), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(draft, False)
        if version in versions(spark, base):
            raise ConflictError(f"version {version} of {base} is there already") from e
        raise
    return Snapshot(version, generated_at, tables)


def bucket_of(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("project", "element"), F.lit(buckets)).cast("int")


def _write(df: DataFrame, base: str, name: str, buckets: int | None) -> dict[str, str]:
    """Write a table, or buckets of it, to a new folder; bucket -> folder of those that have rows."""
    spark = df.sparkSession
    folder = f"{_DATA}/{name}-{uuid.uuid4().hex}"
    columns = [f.split()[0] for f in SCHEMAS[name].split(", ")]
    if buckets is None:
        df.select(*columns).write.parquet(f"{base}/{folder}")
        return {"0": folder}
    rows = df.select(*columns, bucket_of(buckets).alias("bucket")).hint("rebalance", "bucket")
    rows.write.partitionBy("bucket").parquet(f"{base}/{folder}")
    found = [s.getPath().getName() for s in _fs(spark, base).listStatus(_path(spark, f"{base}/{folder}"))]
    return {n.split("=")[1]: f"{folder}/{n}" for n in found if n.startswith("bucket=")}


def commit(spark: SparkSession, base: str, tables: dict[str, DataFrame], generated_at: datetime.datetime | None = None,
           since: Snapshot | None = None, buckets: int = BUCKETS) -> Snapshot:
    """Add a snapshot in which ``tables`` are as given and all others as they were in ``since`` (by default the last).

    ``generated_at``: the time that the build carries, by default now (C19)."""
    since = snapshot(spark, base) if since is None else since
    now = generated_at or datetime.datetime.now(datetime.timezone.utc)
    written = {name: _write(df, base, name, buckets if name == "docs" else None) for name, df in tables.items()}
    return _add_entry(spark, base, since.version + 1, now, {**since.tables, **written})


def update_docs(spark: SparkSession, base: str, new_docs: DataFrame, changed: DataFrame, generated_at: datetime.datetime | None = None,
                since: Snapshot | None = None, buckets: int = BUCKETS) -> Snapshot:
    """Add a snapshot with the docs that an update operator made of those in ``since``; ``changed`` (project, element)
    are the entries that it may have changed. Only their buckets are written."""
    since = snapshot(spark, base) if since is None else since
    now = generated_at or datetime.datetime.now(datetime.timezone.utc)
    touched = sorted(r.b for r in changed.select(bucket_of(buckets).alias("b")).distinct().collect())  # at most as many as buckets
    written = _write(new_docs.where(bucket_of(buckets).isin(touched)), base, "docs", buckets) if touched else {}
    kept = {b: f for b, f in since.tables.get("docs", {}).items() if int(b) not in touched}
    return _add_entry(spark, base, since.version + 1, now, {**since.tables, "docs": {**kept, **written}})


def log(spark: SparkSession, base: str) -> DataFrame:
    """(version, generated_at, table_name, bucket, folder) of all snapshots."""
    rows = spark.read.text(f"{base}/{_LOG}/*.json", wholetext=True)
    entry = F.from_json("value", "generated_at string, tables map<string, map<string, string>>")
    number = F.regexp_extract(F.expr("_metadata.file_name"), r"(\d+)", 1).cast("long")
    named = rows.select(number.alias("version"), entry.alias("e")).select("version", F.col("e.generated_at").cast("timestamp").alias("generated_at"), F.explode("e.tables").alias("table_name", "folders"))
    return named.select("version", "generated_at", "table_name", F.explode("folders").alias("bucket", "folder"))


def vacuum(spark: SparkSession, base: str, keep: int = 1) -> int:
    """Delete data folders that none of the last ``keep`` snapshots names, and older entries; returns how many folders."""
    there = versions(spark, base)
    used = {f.split("/")[1] for v in there[-keep:] for t in snapshot(spark, base, v).tables.values() for f in t.values()}
    fs = _fs(spark, base)
    gone = [s.getPath() for s in fs.listStatus(_path(spark, f"{base}/{_DATA}")) if s.getPath().getName() not in used]
    for v in there[:-keep]:
        fs.delete(_path(spark, f"{base}/{_LOG}/{v:020d}.json"), False)
    for p in gone:
        fs.delete(p, True)
    return len(gone)
