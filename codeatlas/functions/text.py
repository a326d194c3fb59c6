"""Scalar projections used across operators.

Every helper returns a Spark ``Column`` built from built-in functions so that it
stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_of", "basename", "stem", "extension", "module_to_path", "diagram_id",
    "diagram_label", "dot_quote", "location", "node_key", "edge_label", "type_dir",
    "doc_file_path", "markdown_body", "detect_type", "normalise_path", "join_path",
    "dirname", "iso_date", "TYPE_DIRS", "DOC_EXTENSIONS", "SOURCE_EXTENSIONS",
    "NODE_TYPES", "EDGE_TYPES",
]

# Fixed values that must equal the reference's for identical results.
# Node and edge type literals.
NODE_TYPES = ["file", "module", "class", "function", "variable", "interface", "type", "enum"]
EDGE_TYPES = ["import", "call", "extends", "implements", "uses"]
# Documentation folder per element type; anything else goes to "other".
TYPE_DIRS = {
    "file": "files", "function": "functions", "class": "classes", "interface": "types",
    "type": "types", "enum": "types", "variable": "variables", "module": "modules",
    "page": "pages", "unknown": "other",
}
# Extensions that make a documented name count as a file.
DOC_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".py", ".rs", ".go", ".java", ".rb",
                  ".php", ".vue", ".svelte", ".html", ".css", ".scss"]
# TS/JS source extensions (case-sensitive).
SOURCE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path) -> Column:
    """Last ``/`` segment."""
    return F.element_at(F.split(col_of(path), "/"), -1)


def dirname(path) -> Column:
    """Everything before the last ``/`` ('' when there is none)."""
    return F.regexp_extract(col_of(path), r"^(.*)/[^/]*$", 1)


def extension(path) -> Column:
    """Extension of the base name including the dot ('' when none; leading-dot names have none)."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def stem(path) -> Column:
    """Base name without its extension."""
    b = basename(path)
    return F.regexp_replace(b, r"^(.+)\.[^.]*$", "$1")


def module_to_path(module) -> Column:
    """Python module ``a.b.c`` -> ``a/b/c.py`` (C16); never resolved."""
    return F.concat(F.replace(col_of(module), F.lit("."), F.lit("/")), F.lit(".py"))


def diagram_label(path, element) -> Column:
    """``path[.element]`` before sanitising."""
    e = col_of(element)
    return F.concat(col_of(path), F.when(F.coalesce(e, F.lit("")) != "", F.concat(F.lit("."), e)).otherwise(F.lit("")))


def diagram_id(path, element=None) -> Column:
    """Mermaid node id: characters outside ``[A-Za-z0-9_]`` become ``_``."""
    raw = col_of(path) if element is None else diagram_label(path, element)
    return F.regexp_replace(raw, "[^a-zA-Z0-9_]", "_")


def dot_quote(text) -> Column:
    """Wrap in double quotes, escaping inner quotes."""
    return F.concat(F.lit('"'), F.replace(col_of(text), F.lit('"'), F.lit('\\"')), F.lit('"'))


def location(path, line) -> Column:
    """``path[:line]``; line 0 or null is omitted."""
    ln = col_of(line)
    return F.when(col_of(path).isNull() | (col_of(path) == ""), F.lit(None).cast("string")).otherwise(
        F.concat(col_of(path), F.when(F.coalesce(ln, F.lit(0)) != 0, F.concat(F.lit(":"), ln.cast("string"))).otherwise(F.lit(""))))


def node_key(element, path) -> Column:
    """Graph node of one edge side: the element, else the path; '' counts as absent (C11)."""
    return F.coalesce(F.nullif(col_of(element), F.lit("")), col_of(path))


def edge_label(path, element) -> Column:
    """``path[:element]`` as the browse views print it (C11)."""
    e = col_of(element)
    return F.concat(col_of(path), F.when(F.coalesce(e, F.lit("")) != "", F.concat(F.lit(":"), e)).otherwise(F.lit("")))


def type_dir(type_col) -> Column:
    """Element type -> documentation folder, default ``other``."""
    m = F.create_map(*[F.lit(x) for kv in TYPE_DIRS.items() for x in kv])
    return F.coalesce(F.element_at(m, col_of(type_col)), F.lit("other"))


def doc_file_path(element, type_col) -> Column:
    """``<type_dir>/<safe segments>.md`` (C13): per ``/`` segment, characters that are
    not letters, digits, ``.``, ``_`` or ``-`` become ``_``."""
    safe = F.transform(F.split(col_of(element), "/"),
                       lambda s: F.regexp_replace(s, r"[^\p{L}\p{N}._-]", "_"))
    return F.concat(type_dir(type_col), F.lit("/"), F.array_join(safe, "/"), F.lit(".md"))


def markdown_body(element, content) -> Column:
    """``# element\\n\\ncontent\\n`` (C14)."""
    return F.concat(F.lit("# "), col_of(element), F.lit("\n\n"), col_of(content), F.lit("\n"))


def detect_type(element) -> Column:
    """Struct(type, path): a known file extension makes it a ``file`` at that path,
    else ``unknown`` with an empty path (C25)."""
    is_file = F.lit(False)
    for ext in DOC_EXTENSIONS:
        is_file = is_file | col_of(element).endswith(ext)
    return F.when(is_file, F.struct(F.lit("file").alias("type"), col_of(element).alias("path"))).otherwise(
        F.struct(F.lit("unknown").alias("type"), F.lit("").alias("path")))


def normalise_path(path) -> Column:
    """Fold ``.`` and ``..`` segments of a relative path (C17); leading ``..`` that
    climb above the root are kept."""
    segs = F.filter(F.split(col_of(path), "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."),
                              F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))))
    return F.array_join(folded, "/")


def join_path(base, rel) -> Column:
    """Join a directory and a relative path, then normalise."""
    b = col_of(base)
    return normalise_path(F.when(b == "", col_of(rel)).otherwise(F.concat(b, F.lit("/"), col_of(rel))))


def iso_date(ts) -> Column:
    """Calendar date part (UTC) of a timestamp as ``yyyy-MM-dd`` text."""
    return F.date_format(col_of(ts), "yyyy-MM-dd")
