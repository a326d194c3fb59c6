"""Scan of source trees (S1-S3, F1, F2, U6): directories are listed level by level, on executors.

Spark's own file readers hide names starting with ``_`` or ``.`` (``__init__.py`` would vanish), so the trees are
listed here. A round takes the directories of one depth as a table, spreads them over tasks, and stores what they
hold: files, and the directories of the next round. The driver holds the roots and one flag per round, never a
name. What the ignore rules name is not entered, unless the index of all paths is wanted (imports may name files that
are not scanned). Texts are read by the executors from the table of names, dealt evenly whatever the folders hold.

Symbolic links to directories are not followed; unreadable directories and files are skipped. Roots must be on a
file system that executors see.
"""

from __future__ import annotations

import datetime
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions.ignore import DEFAULT_IGNORE, is_ignored_py
from codeatlas.functions.text import SOURCE_EXTENSIONS
from codeatlas.plans.stored import stored

SCHEMA = "project string, path string, content string, mtime timestamp"
PYTHON_EXTENSIONS = [".py"]
_ENTRY = "project string, root string, path string, is_dir boolean, ignored boolean"


def _wanted(exts: set[str]):
    def wanted(name: str) -> bool:
        # TS/JS rules look at the extension (a bare ".ts" has none); the Python rule at the suffix
        return os.path.splitext(name)[1] in exts or (".py" in exts and name.endswith(".py"))
    return wanted


def list_directory(root: str, rel: str, ignore) -> Iterator[tuple[str, bool, bool]]:
    """(path, is_dir, ignored) of what the directory ``rel`` of ``root`` holds, by name; nothing if it can't be read."""
    try:
        with os.scandir(os.path.join(root, rel) if rel else root) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        path = f"{rel}/{e.name}" if rel else e.name
        yield path, e.is_dir(follow_symlinks=False), is_ignored_py(path, ignore)


def _lister(ignore: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in batch.to_pylist():
                rows = [(d["project"], d["root"], path, is_dir, d["ignored"] or ignored) for path, is_dir, ignored in list_directory(d["root"], d["path"], ignore)]
                kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["project", "root", "path", "is_dir", "ignored"])
    return run


def tree_paths(spark: SparkSession, roots: dict[str, str], ignore=None, enter_ignored: bool = False) -> DataFrame:
    """(project, root, path, ignored) of every file of the trees, whatever its suffix; ``enter_ignored`` also lists
    what the ignore rules keep out of a scan."""
    ignore = DEFAULT_IGNORE if ignore is None else list(ignore)
    level = spark.createDataFrame([(p, r, "", True, False) for p, r in sorted(roots.items())], _ENTRY)
    files = None
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        # Dealt by path, so that a wide level is listed by all tasks.
        found = stored(level.repartition(tasks, "project", "path").mapInArrow(_lister(ignore), _ENTRY))
        if not enter_ignored:
            found = found.where("not ignored")
        here = found.where("not is_dir").select("project", "root", "path", "ignored")
        files = here if files is None else files.unionByName(here)
        level = found.where("is_dir")
        if level.isEmpty():
            return files


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():  # a file at a time: texts may be long
            full = os.path.join(row["root"], row["path"])
            try:  # newline="": line ends stay as they are; bytes that are no UTF-8 are replaced
                with open(full, encoding="utf-8", errors="replace", newline="") as fh:
                    content = fh.read()
                mtime = datetime.datetime.fromtimestamp(os.stat(full).st_mtime, tz=datetime.timezone.utc)
            except OSError:
                continue
            yield pa.RecordBatch.from_arrays([pa.array([row["project"]]), pa.array([row["path"]]), pa.array([content], pa.string()), pa.array([mtime], pa.timestamp("us", "UTC"))],
                                             names=["project", "path", "content", "mtime"])


def scan_sources(spark: SparkSession, roots: dict[str, str], ignore=None, extensions=None,
                 files_per_partition: int = 64, paths: DataFrame | None = None) -> DataFrame:
    """``source_files(project, path, content, mtime)`` for each project root (S1-S3). ``paths``: the trees'
    ``tree_paths``, if they are there already."""
    paths = tree_paths(spark, roots, ignore) if paths is None else paths
    wanted = [e for e in (SOURCE_EXTENSIONS + PYTHON_EXTENSIONS if extensions is None else extensions)]
    name = F.element_at(F.split("path", "/"), -1)
    # Of a name that starts with dots the extension is what follows a later dot.
    keep = F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1).isin(wanted)
    if ".py" in wanted:
        keep = keep | name.endswith(".py")
    names = stored(paths.where(~F.col("ignored") & keep).select("project", "root", "path"))
    slices = max(1, -(-names.count() // files_per_partition))
    return names.repartition(slices, "project", "path").mapInArrow(_read_texts, SCHEMA)  # each path of a root is met once
