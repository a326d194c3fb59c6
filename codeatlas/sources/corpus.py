"""A code-graph corpus derived from the driver's TPC-H-ish tables.

The driver tables hold no source code, so every registered query runs on tables
Spark derives here from ``lineitem``, ``part``, ``documents``, ``benchmark`` and
``pages``. Each derivation is a narrow projection (or one equi-join) over *all*
rows, so the work grows with the inputs. The same derivations exist as SQL text in
:mod:`codeatlas.plans.oracle` for the DuckDB check.

* ``elements``: one per part, in four projects ``repo0..repo3``.
* ``files``: distinct element paths (``src/b<brand>/m<size>.ts``).
* ``edges``: one per lineitem (joined to its part for names).
* ``docs``: one per part that has a document, plus one free page per benchmark item.
* ``src_lines``: four lines of Python text per part (for the extraction operators).
* ``links``: one edge per ``href`` in ``pages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the derivation (shared with the SQL oracle).
N_PROJECTS = 4
ORDER_FILES = 997
NAME_SUFFIXES = 97
SRC_FILES_PER_BRAND = 10
TYPE_OF_PTYPE = {"ECONOMY": "function", "SMALL": "class", "MEDIUM": "interface",
                 "PROMO": "type", "STANDARD": "enum", "LARGE": "variable"}
EDGE_OF_FLAG = {"A": "import", "N": "call", "R": "extends"}
EPOCH_2024 = 1704067200  # 2024-01-01T00:00:00Z


# Schemas of the given tables: stating them saves a job per table that would read file footers.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _map_col(mapping: dict, key):
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def _project(key) -> F.Column:
    return F.concat(F.lit("repo"), (key % N_PROJECTS).cast("string"))


def _element_name(p_name, key) -> F.Column:
    return F.concat(F.replace(p_name, F.lit(" "), F.lit("_")), F.lit("_"), (key % NAME_SUFFIXES).cast("string"))


def _element_path(p_brand, p_size) -> F.Column:
    return F.concat(F.lit("src/b"), F.replace(p_brand, F.lit("Brand#"), F.lit("")), F.lit("/m"),
                    p_size.cast("string"), F.lit(".ts"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = _element_name(F.col("p_name"), F.col("p_partkey"))
    path = _element_path(F.col("p_brand"), F.col("p_size"))
    etype = _map_col(TYPE_OF_PTYPE, F.col("p_type"))
    sig = (F.when(etype == "function", F.concat(name, F.lit("(size"), F.col("p_size").cast("string"), F.lit(")")))
           .when(etype == "class", F.concat(F.lit("class "), name))
           .when(etype == "interface", F.concat(F.lit("interface "), name)))
    doc = F.when(F.col("p_size") % 5 != 0,
                 F.concat(F.lit("Part "), F.col("p_name"), F.lit(" of "), F.col("p_brand")))
    return p.select(
        _project(F.col("p_partkey")).alias("project"),
        path.alias("path"),
        F.col("p_partkey").alias("elem_ord"),
        F.concat(path, F.lit(":"), name).alias("id"),
        name.alias("name"),
        etype.alias("type"),
        ((F.col("p_partkey") % 1000) + 1).cast("int").alias("line"),
        sig.alias("signature"),
        doc.alias("doc_comment"),
        (F.col("p_partkey") % 2 == 0).alias("exported"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file (file order is path order), exports gathered from the
    file's exported elements."""
    from codeatlas.operators.nodes import file_exports

    return file_exports(elements(spark, sf_dir))


def file_mtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_files`` stand-in for staleness: mtime is a function of the path."""
    el = elements(spark, sf_dir).select("project", "path").distinct()
    size = F.regexp_extract("path", r"/m(\d+)\.ts$", 1).cast("long")
    return el.select("project", "path", F.timestamp_seconds(F.lit(EPOCH_2024) + size * 7 * 86400).alias("mtime"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    j = li.join(p, li.l_partkey == p.p_partkey, "inner")
    to_el = F.when(F.col("l_linenumber") % 4 != 0, _element_name(F.col("p_name"), F.col("p_partkey")))
    from_el = F.when(F.col("l_linenumber") % 3 != 0, _element_name(F.col("p_name"), F.col("l_suppkey")))
    return j.select(
        _project(F.col("l_partkey")).alias("project"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge_ord"),
        F.concat(F.lit("src/orders/o"), (F.col("l_orderkey") % ORDER_FILES).cast("string"), F.lit(".ts")).alias("src_path"),
        _element_path(F.col("p_brand"), F.col("p_size")).alias("dst_path"),
        _map_col(EDGE_OF_FLAG, F.col("l_returnflag")).alias("type"),
        from_el.alias("from_element"),
        to_el.alias("to_element"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element docs (part joined to its document) plus free pages (benchmark items).

    German documents name a retired element (orphaned); French ones point at a
    moved file (file not found)."""
    p = table(spark, sf_dir, "part")
    d = table(spark, sf_dir, "documents")
    j = p.join(d, p.p_partkey == d.doc_id, "inner")
    name = _element_name(F.col("p_name"), F.col("p_partkey"))
    element = F.when(F.col("lang") == "de", F.concat(name, F.lit("_legacy"))).otherwise(name)
    path = _element_path(F.col("p_brand"), F.col("p_size"))
    path = F.when(F.col("lang") == "fr", F.replace(path, F.lit(".ts"), F.lit(".old.ts"))).otherwise(path)
    created = F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("doc_id") * 3600)
    updated = F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("doc_id") * 3600 + (F.col("n_chars") % 400) * 86400)
    etype = _map_col(TYPE_OF_PTYPE, F.col("p_type"))
    el_docs = j.select(
        _project(F.col("p_partkey")).alias("project"),
        F.col("doc_id").alias("doc_ord"),
        element.alias("element"), path.alias("path"), etype.alias("type"),
        F.col("text").alias("content"),
        F.array(F.col("source"), F.concat(F.col("lang"), F.lit("_"), F.col("p_type"))).alias("aliases"),
        F.when(F.col("lang") == "en", F.lit("auto")).otherwise(F.lit("manual")).alias("source"),
        created.alias("created_at"), updated.alias("updated_at"),
    )
    b = table(spark, sf_dir, "benchmark")
    pages = b.select(
        _project(F.col("item_id")).alias("project"),
        (F.lit(1 << 40) + F.col("item_id")).alias("doc_ord"),
        F.concat(F.lit("page_"), F.col("item_id").cast("string")).alias("element"),
        F.lit("").alias("path"), F.lit("page").alias("type"),
        F.col("text").alias("content"),
        F.array().cast("array<string>").alias("aliases"),
        F.lit("manual").alias("source"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("item_id") * 60).alias("created_at"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("item_id") * 60).alias("updated_at"),
    )
    out = el_docs.unionByName(pages)
    return out.withColumn("markdown", F.concat(F.lit("# "), F.col("element"), F.lit("\n\n"), F.col("content"), F.lit("\n")))


def _src_stem(shift: int = 0) -> F.Column:
    return ((F.col("p_size") + shift) % SRC_FILES_PER_BRAND).cast("string")


def _dealt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, dealt to many tasks: the text made of a part is many times its row, and one split may hold millions."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").repartition("p_partkey")


def src_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python text: four lines per part in ``pkg/b<brand>/m<size % 10>.py``.

    Line numbers come from the key (``p_partkey * 4 + j + 1``), so they are unique
    and ordered within a file without a window."""
    p = _dealt_parts(spark, sf_dir)
    name = F.lower(_element_name(F.col("p_name"), F.col("p_partkey")))
    cls = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 20))
    brand = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit(""))
    header = (F.when(F.col("p_type").isin("SMALL", "MEDIUM"),
                     F.concat(F.lit("class "), cls, F.lit("(Base"), (F.col("p_size") % 5).cast("string"), F.lit("):")))
              .otherwise(F.concat(F.lit("def "), name, F.lit("(x):"))))
    doc = F.concat(F.lit('    """'), F.lower(F.col("p_type")), F.lit(" part "), F.col("p_name"), F.lit('."""'))
    body = F.concat(F.lit("    return helper_"), F.col("p_size").cast("string"), F.lit("(x) + self.scale(x)"))
    tail = (F.when(F.col("p_type") == "PROMO",
                   F.concat(F.lit("from lib.b"), brand, F.lit(" import "), name, F.lit(", util as u")))
            .when(F.col("p_type") == "LARGE",
                  F.concat(F.lit("LIMIT_"), F.col("p_partkey").cast("string"), F.lit(" = "), F.col("p_size").cast("string")))
            .when(F.col("p_type") == "STANDARD", F.lit("import os, sys"))
            .otherwise(F.lit("")))
    x = p.select(
        _project(F.col("p_partkey")).alias("project"),
        F.concat(F.lit("pkg/b"), brand, F.lit("/m"), _src_stem(), F.lit(".py")).alias("path"),
        F.col("p_partkey"),
        F.posexplode(F.array(header, doc, body, tail)).alias("j", "line"),
    )
    return x.select("project", "path", (F.col("p_partkey") * 4 + F.col("j") + 1).alias("line_no"), "line")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperlink multigraph from raw pages: one edge per ``href`` occurrence."""
    pg = table(spark, sf_dir, "pages")
    x = pg.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("pos", "href"))
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return x.select(
        host.alias("project"),
        (F.shiftleft("page_id", 32) + F.col("pos")).alias("edge_ord"),
        F.col("url").alias("src_path"),
        F.col("href").alias("dst_path"),
        F.lit("import").alias("type"),
        F.lit(None).cast("string").alias("from_element"),
        F.lit(None).cast("string").alias("to_element"),
    )


def src_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_files(project, path, content)`` assembled from :func:`src_lines`
    (lines of one file joined in line order)."""
    ln = src_lines(spark, sf_dir)
    return (ln.groupBy("project", "path")
            .agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
            .select("project", "path", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("content")))


def ts_src_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TypeScript text: five lines per part in ``web/b<brand>/m<size % 10>.ts``.

    ECONOMY/PROMO parts become functions, SMALL/MEDIUM classes, STANDARD interfaces (every other one behind a type
    alias on its line), LARGE a ``const`` of two or three declarators; the key picks one of several shapes of each:
    object and generic types in heads and headers, calls as base classes, commas in comments, comparisons, optional
    calls. PROMO/STANDARD parts add a named import from another file, SMALL parts a default import. Every third
    size gets a JSDoc block."""
    p = _dealt_parts(spark, sf_dir)
    key = F.col("p_partkey").cast("string")
    shape = F.col("p_partkey") % 3
    name = F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("_"), key)
    cls = F.concat(F.lit("C"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), key)
    size = F.col("p_size").cast("string")
    brand = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit(""))
    t = F.col("p_type")
    base = F.concat(F.lit("Base"), (F.col("p_size") % 5).cast("string"))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    doc = F.when(F.col("p_size") % 3 == 0, text("/** ", F.lower(t), " part.\n * @since 1\n */")).otherwise(text("// plain ", key))
    function = (F.when(shape == 0, text("export function ", name, '(x: number, y = "a,b"): number {'))
                .when(shape == 1, text("export function ", name, "(x: Map<string, number>, cb: () => void): { d: string } {"))
                .otherwise(text("function ", name, "<T extends { a: string }>(x: T): Promise<{ a: string }> {")))
    klass = (F.when(shape == 0, text("export class ", cls, " extends ", base, " implements I", (F.col("p_partkey") % 4).cast("string"), ", J {"))
             .when(shape == 1, text("export class ", cls, " extends mixin(", base, ", Q) implements I1<A, B> {"))
             .otherwise(text("class ", cls, " extends ", base, "<{ a: string }> {")))
    interface = F.when(shape == 1, text("type V", name, "<T = string> = T; interface I", name, " {")).otherwise(text("interface I", name, " {"))
    const = (F.when(shape == 0, text("const LIMIT_", key, " = ", size, ", /* x, y */ alt", key, " = (x) => x < 3, far", key, " = 5; // no, comma"))
             .otherwise(text("export const LIMIT_", key, " = ", size, ", alt", key, ' = "{";')))
    header = (F.when(t.isin("ECONOMY", "PROMO"), function).when(t.isin("SMALL", "MEDIUM"), klass).when(t == "STANDARD", interface).otherwise(const))
    body = (F.when(t.isin("ECONOMY", "PROMO"), text("  return helper", size, F.when(shape == 2, "<T>").otherwise(""), "(x) + util.scale", F.when(shape == 1, "?.").otherwise(""), "(y); // }"))
            .when(t.isin("SMALL", "MEDIUM"), text("  method", key, "() { return this.run(", size, "); }"))
            .when(t == "STANDARD", text("  field", key, ": string;"))
            .otherwise(F.lit("")))
    close = F.when(t == "LARGE", F.lit("")).otherwise(F.lit("}"))
    imp = (F.when(t.isin("PROMO", "STANDARD"), text("import { h", key, ", type T", key, " as U } from './m", _src_stem(3), ".js';"))
           .when(t == "SMALL", text("import Def", key, " from 'lib", size, "';"))
           .otherwise(F.lit("")))
    x = p.select(
        _project(F.col("p_partkey")).alias("project"),
        F.concat(F.lit("web/b"), brand, F.lit("/m"), _src_stem(), F.lit(".ts")).alias("path"),
        F.col("p_partkey"), F.posexplode(F.array(doc, header, body, close, imp)).alias("j", "line"))
    return x.select("project", "path", (F.col("p_partkey") * 5 + F.col("j") + 1).alias("line_no"), "line")


def ts_src_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ln = ts_src_lines(spark, sf_dir)
    return (ln.groupBy("project", "path")
            .agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
            .select("project", "path", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("content")))


def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_files`` of one small project per supplier: a source file, marker files and, for most, a
    ``package.json`` (every eleventh is no JSON)."""
    k = F.col("s_suppkey")
    text = k.cast("string")
    deps = F.concat(F.when(k % 7 == 0, F.lit('{"next":"14",')).otherwise(F.lit('{"react":"17",')), F.lit('"lib'), (k % 4).cast("string"), F.lit('":"1"}'))
    dev = F.when(k % 2 == 0, F.lit('{"react":"18"}')).otherwise(F.lit('{"vue":"3"}'))
    bins = F.when(k % 2 == 0, F.concat(F.lit('"bin/n'), F.col("s_nationkey").cast("string"), F.lit('.js"'))).otherwise(F.lit('{"a":"bin/a.js","b":"bin/b.js"}'))
    package = F.when(k % 11 == 0, F.lit("not json")).otherwise(F.concat(
        F.lit('{"main":"dist/m'), (k % 9).cast("string"), F.lit('.js","bin":'), bins, F.lit(',"dependencies":'), deps, F.lit(',"devDependencies":'), dev, F.lit("}")))
    one = lambda path, content, when: F.when(when, F.struct(path.alias("path"), content.alias("content")))
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("sup"), text).alias("project"), F.explode(F.array_compact(F.array(
        one(F.when(k % 4 == 0, F.lit("lib/x.js")).otherwise(F.lit("src/index.ts")), F.concat(F.lit("export const v = "), text, F.lit(";")), F.lit(True)),
        one(F.lit("package.json"), package, k % 5 != 0),
        one(F.lit("tsconfig.json"), F.lit("{}"), k % 3 == 0),
        one(F.lit("pyproject.toml"), F.lit(""), (k % 3 == 1) & (k % 5 == 0))))).alias("f"))
    return rows.select("project", "f.path", "f.content")


def mixed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_files`` with one file per part, in eight kinds of places -- scanned and ignored folders, wanted and
    other suffixes; each row twice."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey").cast("string")
    place = F.floor(F.col("p_partkey") / N_PROJECTS) % 8
    path = lambda before, after: F.concat(F.lit(before), k, F.lit(after))
    paths = [path("src/m", ".ts"), path("node_modules/m", ".ts"), path("src/dist/m", ".js"), path("pkg/x.egg-info/m", ".py"), path("src/m", ".d.ts"),
             path("pkg/distance", ".py"), path("gen/code/m", ".mjs"), path("src/readme", ".md")]
    rows = p.select(_project(F.col("p_partkey")).alias("project"), F.element_at(F.array(*paths), (place + 1).cast("int")).alias("path"), k.alias("content"))
    return rows.unionByName(rows)
