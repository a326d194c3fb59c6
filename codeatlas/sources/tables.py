"""Stored tables (S4-S7, S12): explicit schemas, versioned writes, JSON export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Explicit schemas: never inferred.
SCHEMAS = {
    "source_files": "project string, path string, content string, mtime timestamp",
    "projects": "project string, name string, source_paths array<string>, ignore array<string>, language string, framework string",
    "files": "project string, path string, name string, exports array<string>",
    "elements": ("project string, path string, elem_ord bigint, id string, name string, type string, line int, "
                 "signature string, doc_comment string, exported boolean"),
    "edges": "project string, edge_ord bigint, src_path string, dst_path string, type string, from_element string, to_element string",
    "docs": ("project string, doc_ord bigint, element string, path string, type string, content string, markdown string, "
             "aliases array<string>, source string, created_at timestamp, updated_at timestamp"),
}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, base: str, name: str) -> list[int]:
    fs, p = _fs(spark, f"{base}/{name}")
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        n = st.getPath().getName()
        if n.startswith("v=") and fs.exists(st.getPath().suffix("/_SUCCESS")):
            out.append(int(n[2:]))
    return sorted(out)


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Latest committed version of a table; an absent table is empty with its schema."""
    vs = _versions(spark, base, name)
    schema = SCHEMAS[name]
    if not vs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/{name}/v={vs[-1]}")


def write_table(df: DataFrame, base: str, name: str) -> int:
    """Write ``df`` as the next version, partitioned by project (S5, S7). Readers keep
    seeing the previous version until the new one is complete (``_SUCCESS``), so an
    update that reads and rewrites the same table never overwrites its own input."""
    spark = df.sparkSession
    vs = _versions(spark, base, name)
    v = (vs[-1] + 1) if vs else 1
    df.write.mode("errorifexists").partitionBy("project").parquet(f"{base}/{name}/v={v}")
    return v


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON document per row (S12); nulls are dropped as JSON serialisation does."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
