"""Project manifests and language detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Detection order of root marker files and framework dependencies.
LANGUAGE_MARKERS = [("tsconfig.json", "typescript"), ("package.json", "javascript"), ("Cargo.toml", "rust"),
                    ("go.mod", "go"), ("requirements.txt", "python"), ("pyproject.toml", "python")]
FRAMEWORKS = [("next", "next.js"), ("react", "react"), ("vue", "vue"), ("express", "express"), ("fastify", "fastify")]

_PKG_SCHEMA = "main string, dependencies map<string,string>, devDependencies map<string,string>"


def manifests(source_files: DataFrame) -> DataFrame:
    """Root ``package.json`` of each project -> (project, main, bins, deps).
    Bad JSON gives nulls; ``bin`` may be a string or an object of names to paths;
    dependency maps merge with dev entries winning (U7)."""
    pkg = source_files.where(F.col("path") == "package.json")
    parsed = F.from_json("content", _PKG_SCHEMA, {"mode": "PERMISSIVE"})
    raw_bin = F.get_json_object("content", "$.bin")
    bin_map = F.from_json(raw_bin, "map<string,string>")
    bins = F.when(raw_bin.isNull(), F.array().cast("array<string>")) \
        .when(F.ltrim(raw_bin).startswith("{"), F.map_values(bin_map)) \
        .otherwise(F.array(raw_bin))
    dev = F.coalesce(parsed["devDependencies"], F.create_map().cast("map<string,string>"))
    prod = F.coalesce(parsed["dependencies"], F.create_map().cast("map<string,string>"))
    # dev entries win on a shared key: drop those keys from the first map before concatenating
    deps = F.map_concat(F.map_filter(prod, lambda k, v: ~F.array_contains(F.map_keys(dev), k)), dev)
    return pkg.select("project", parsed["main"].alias("main"), bins.alias("bins"), deps.alias("deps"))


def detect_language(source_files: DataFrame) -> DataFrame:
    """(project, language, framework, source_paths) from root marker files (X20):
    first marker in the fixed order wins, else ``unknown``; framework from the
    first known dependency; source root ``src`` when present, else ``.``."""
    flags = source_files.groupBy("project").agg(
        *[F.max((F.col("path") == m).cast("int")).alias(f"_m{i}") for i, (m, _) in enumerate(LANGUAGE_MARKERS)],
        F.max(F.col("path").startswith("src/").cast("int")).alias("_src"))
    lang = F.lit("unknown")
    for i, (_, name) in reversed(list(enumerate(LANGUAGE_MARKERS))):
        lang = F.when(F.col(f"_m{i}") == 1, F.lit(name)).otherwise(lang)
    m = manifests(source_files).select("project", "deps")
    fw = F.lit(None).cast("string")
    for dep, name in reversed(FRAMEWORKS):
        fw = F.when(F.coalesce(F.array_contains(F.map_keys("deps"), dep), F.lit(False)), F.lit(name)).otherwise(fw)
    return (flags.join(m, "project", "left")
            .select("project", lang.alias("language"), fw.alias("framework"),
                    F.when(F.col("_src") == 1, F.array(F.lit("src"))).otherwise(F.array(F.lit("."))).alias("source_paths")))
