"""Markdown files of the docs (S8, M6), written by a data source with a two-phase commit.

``write_markdown`` gives each document its file ``<out>/<project>/<type folder>/<name>.md``. Tasks write their files
to a staging folder of the job, one per attempt; nothing below ``<out>`` is touched until all have succeeded. The
commit records in a journal which attempts count -- that file's rename is the decision -- then puts their files in
place and takes away files that documents have left for another type's folder. A job that fails before the journal
leaves the old state; one that dies after it is finished by the next write, as every step of it can be repeated.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from codeatlas.operators.docs import with_markdown
from codeatlas.operators.maintain import markdown_moves

_STAGING, _JOURNAL, _REMOVED = "_staging", "_journal", "_removed"
_THREADS = 16


@dataclass
class _Written(WriterCommitMessage):
    folder: str


def _target(out: str, project: str, path: str) -> str:
    full = os.path.normpath(os.path.join(out, project, path))
    if not full.startswith(os.path.normpath(out) + os.sep):
        raise ValueError(f"{project}/{path} is outside the folder of the documents")
    return full


class _Writer(DataSourceWriter):
    def __init__(self, out: str):
        self.out, self.job = out, uuid.uuid4().hex
        os.makedirs(os.path.join(out, _STAGING, self.job), exist_ok=True)

    def write(self, iterator):
        folder = os.path.join(_STAGING, self.job, uuid.uuid4().hex)
        here = os.path.join(self.out, folder)
        os.makedirs(here)
        with open(os.path.join(here, _REMOVED), "w", encoding="utf-8") as removed:
            for row in iterator:
                if row["markdown"] is None:
                    removed.write(json.dumps([row["project"], row["md_path"]]) + "\n")
                    continue
                _target(self.out, row["project"], row["md_path"])
                full = _target(here, row["project"], row["md_path"])
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "w", encoding="utf-8", newline="") as fh:
                    fh.write(row["markdown"])
        return _Written(folder)

    def commit(self, messages):
        os.makedirs(os.path.join(self.out, _JOURNAL), exist_ok=True)
        journal = os.path.join(self.out, _JOURNAL, f"{self.job}.json")
        with open(journal + ".new", "w", encoding="utf-8") as fh:
            json.dump({"job": self.job, "folders": [m.folder for m in messages if m is not None]}, fh)
        os.replace(journal + ".new", journal)  # from here on the write counts
        finish(self.out)

    def abort(self, messages):
        shutil.rmtree(os.path.join(self.out, _STAGING, self.job), ignore_errors=True)


def finish(out: str) -> int:
    """Put the files of journalled writes in place; returns how many writes there were."""
    folder = os.path.join(out, _JOURNAL)
    journals = sorted(f for f in (os.listdir(folder) if os.path.isdir(folder) else []) if f.endswith(".json"))
    for name in journals:
        with open(os.path.join(folder, name), encoding="utf-8") as fh:
            entry = json.load(fh)
        with ThreadPoolExecutor(_THREADS) as pool:
            list(pool.map(lambda f: _publish(out, os.path.join(out, f)), entry["folders"]))
            list(pool.map(lambda f: _remove(out, os.path.join(out, f)), entry["folders"]))
        os.remove(os.path.join(folder, name))
        shutil.rmtree(os.path.join(out, _STAGING, entry["job"]), ignore_errors=True)
    return len(journals)


def _publish(out: str, staged: str) -> None:
    for base, _, files in os.walk(staged):
        rel = os.path.relpath(base, staged)
        if rel != "." and files:
            os.makedirs(os.path.join(out, rel), exist_ok=True)
            for f in files:
                os.replace(os.path.join(base, f), os.path.join(out, rel, f))


def _remove(out: str, staged: str) -> None:
    listed = os.path.join(staged, _REMOVED)
    if os.path.exists(listed):
        with open(listed, encoding="utf-8") as fh:
            for line in fh:
                full = _target(out, *json.loads(line))
                if os.path.exists(full):
                    os.remove(full)


class MarkdownFiles(DataSource):
    @classmethod
    def name(cls):
        return "markdown_files"

    def schema(self):
        return "project string, md_path string, markdown string"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def write_markdown(docs: DataFrame, out: str, before: DataFrame | None = None) -> None:
    """Write the documents' markdown; with ``before``, the table of docs that the files show, only what differs from
    it, and files of documents that changed their folder go. Of documents that share a file the last in table order
    is written."""
    spark = docs.sparkSession
    spark.dataSource.register(MarkdownFiles)
    finish(out)
    rows = _files(docs)
    if before is not None:
        old = _files(before).select("project", "md_path", F.col("markdown").alias("_old"))
        moved = markdown_moves(before, docs).select("project", F.col("old_md_path").alias("md_path")).distinct()
        gone = moved.join(rows, ["project", "md_path"], "left_anti").withColumn("markdown", F.lit(None).cast("string"))
        changed = rows.join(old, ["project", "md_path"], "left").where(~F.col("markdown").eqNullSafe(F.col("_old"))).drop("_old")
        rows = changed.unionByName(gone)
    rows.write.format("markdown_files").mode("append").option("path", out).save()


def _files(docs: DataFrame) -> DataFrame:
    one = with_markdown(docs).groupBy("project", "md_path").agg(F.max_by("markdown", "doc_ord").alias("markdown"))
    return one.select("project", "md_path", F.coalesce("markdown", F.lit("")).alias("markdown"))


def read_markdown_files(spark: SparkSession, out: str) -> DataFrame:
    """(project, md_path, markdown) of the files below ``out``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(out, wholetext=True)
    name = F.regexp_extract(F.expr("_metadata.file_path"), r"([^/]+/[^/]+/[^/]+)$", 1)
    path = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return files.select(F.substring_index(path, "/", 1).alias("project"), F.regexp_replace(path, r"^[^/]*/", "").alias("md_path"), F.col("value").alias("markdown"))
