"""Build the code tables from source text.

``source_files(project, path, content[, mtime])`` + ``projects(project, language,
ignore, ...)`` -> ``files``, ``elements``, ``edges``. Each project's language picks
its rules: ``python`` -> Python rules on ``.py`` files, anything else -> TS/JS rules
on the eight TS/JS suffixes (X19). Ignore patterns may differ per project, so the
ignore test is a per-row higher-order expression over the project's own list.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions.ignore import DEFAULT_IGNORE
from codeatlas.functions.text import SOURCE_EXTENSIONS, basename
from codeatlas.operators import extract_python, extract_ts
from codeatlas.operators.nodes import file_exports
from codeatlas.plans.stored import stored


class Tables(NamedTuple):
    files: DataFrame
    elements: DataFrame
    edges: DataFrame


def ignored_by(path_col: str = "path", patterns_col: str = "ignore") -> F.Column:
    """F1 with a per-row pattern list (the project's own ignore list)."""
    segs = F.split(F.col(path_col), "/")
    return F.coalesce(F.exists(F.col(patterns_col), lambda p: F.when(p.contains("/"), F.col(path_col).contains(p))
                                .when(p.startswith("*."), F.exists(segs, lambda s: s.endswith(F.substring(p, 2, 1 << 20))))
                                .otherwise(F.array_contains(segs, p))), F.lit(False))


def select_sources(source_files: DataFrame, projects: DataFrame) -> DataFrame:
    """Source files each project's rules read: not ignored (F1), right suffix (F2)."""
    default_ignore = F.array(*[F.lit(x) for x in DEFAULT_IGNORE])
    ign = F.coalesce("ignore", default_ignore) if "ignore" in projects.columns else default_ignore
    pj = projects.select("project", F.coalesce("language", F.lit("unknown")).alias("language"), ign.alias("ignore"))
    if "source_paths" in projects.columns:
        pj = pj.join(projects.select("project", "source_paths"), "project")
    else:
        pj = pj.withColumn("source_paths", F.lit(None).cast("array<string>"))
    # Chosen on thin rows; the texts then meet the chosen paths on the file key, so no project is one task.
    j = source_files.where(F.col("content").isNotNull()).select("project", "path").join(pj, "project")
    under = F.coalesce(F.exists("source_paths", lambda sp: (sp == ".") | (sp == "") | F.col("path").startswith(F.concat(sp, F.lit("/")))),
                       F.lit(True))
    j = j.where(under)
    ext = F.regexp_extract(basename("path"), r"^.+(\.[^.]*)$", 1)
    is_py = F.col("language") == "python"
    keep = F.when(is_py, F.col("path").endswith(".py")).otherwise(ext.isin(SOURCE_EXTENSIONS))
    chosen = j.where(keep & ~ignored_by("path", "ignore")).select("project", "path", "language").distinct()
    return source_files.where(F.col("content").isNotNull()).join(chosen, ["project", "path"]).dropDuplicates(["project", "path"])


def build(source_files: DataFrame, projects: DataFrame, paths: DataFrame | None = None) -> Tables:
    """``paths`` (project, path): all files that imports may name, by default those of ``source_files``."""
    # read by the choice of paths, by the texts' meeting with it and by the imports: made once, kept in the shared folder
    source_files = stored(source_files)
    # likewise, by both language branches and by the files table
    src = stored(select_sources(source_files, projects))
    py = src.where(F.col("language") == "python").select("project", "path", "content")
    ts = src.where(F.col("language") != "python").select("project", "path", "content")
    scan = stored(extract_ts.scanned(ts))  # one pass over TS/JS text for elements and edges
    elements = extract_python.python_elements(py).unionByName(extract_ts.ts_elements(None, scan))
    edges = extract_python.python_edges(py).unionByName(extract_ts.ts_edges(None, source_files.select("project", "path") if paths is None else paths, scan))
    ex = file_exports(elements).select("project", "path", "exports")
    files = (src.select("project", "path", basename("path").alias("name"))
             .join(ex, ["project", "path"], "left")
             .select("project", "path", "name", F.coalesce("exports", F.array().cast("array<string>")).alias("exports")))
    return Tables(files, elements, edges)


def build_from_trees(spark: SparkSession, roots: dict[str, str], languages: dict[str, str] | None = None,
                     ignore=None) -> Tables:
    """Scan project roots (S1) and build; languages default to detection from root
    marker files (X20)."""
    from codeatlas.sources.manifest import detect_language
    from codeatlas.sources.source_tree import scan_sources, tree_paths

    exts = SOURCE_EXTENSIONS + [".py", ".json", ".toml", ".txt", ".mod"]
    # All names, as imports may name files that no rule scans; only texts that are read are not ignored.
    paths = tree_paths(spark, roots, ignore, enter_ignored=True)
    src = scan_sources(spark, roots, extensions=exts, paths=paths)
    if languages:
        projects = spark.createDataFrame(sorted(languages.items()), "project string, language string") \
            .withColumn("ignore", F.lit(None).cast("array<string>"))
    else:
        projects = detect_language(src).withColumn("ignore", F.lit(None).cast("array<string>"))
    if ignore is not None:
        projects = projects.withColumn("ignore", F.array(*[F.lit(x) for x in ignore]))
    return build(src, projects, paths.select("project", "path"))
