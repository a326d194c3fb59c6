"""Python source text -> elements and edges (X1-X7, F15, C16), as Spark jobs.

Input is ``source_files(project, path, content)``. A file's lines are cut into blocks of ``BLOCK`` lines, each with
the two lines that follow it, by a generator over the row: line rules, and those that look two lines ahead, are
plain projections without a shuffle. What reaches further is a segmented scan: each block is summarised, the
summaries of a file are combined in order (one row per block), and a block's rows start from what its
predecessors leave. So a file of any length spreads over as many tasks as it has blocks.

* call scope (X6, W3): a ``def`` at indent 0/4 sets the scope, a non-indented non-def non-class line resets it to
  null (the struct wrapper keeps a null scope from being skipped). Summary: the block's last marker.
* docstrings over several lines (X4, W4): summary per quote: the first line of the block that holds it. The
  body is put together from the slices of the blocks it touches.
* places of elements and edges: summary: how many the block holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.functions.text import module_to_path
from codeatlas.plans.partitioning import numbered
from codeatlas.plans.stored import stored

FILE = ["project", "path"]
#: Lines in a block.
BLOCK = 4096

# Matching rules and stop words.
DEF_RE = r"^def\s+([a-zA-Z_]\w*)\s*\("
CLASS_RE = r"^class\s+([a-zA-Z_]\w*)\s*[:(]"
VAR_RE = r"^([a-zA-Z_]\w*)\s*[=:]"
SCOPE_DEF_RE = r"^(\s*)def\s+([a-zA-Z_]\w*)\s*\("
CALL_RE = r"([a-zA-Z_][\w.]*)\s*\("
FROM_IMPORT_RE = r"^from\s+([\w.]+)\s+import\s+(.+)"
IMPORT_RE = r"^import\s+(.+)"
BASES_RE = r"^class\s+([a-zA-Z_]\w*)\s*\(([^)]+)\)"
VAR_STOP_WORDS = ["if", "for", "while", "with", "try", "elif", "else", "except", "finally",
                  "return", "yield", "raise", "import", "from"]
CALL_STOP_WORDS = ["if", "for", "while", "with", "def", "class", "return", "print", "elif", "except", "lambda"]
QUOTES = ['"""', "'''", '"', "'"]


def _trim(c) -> F.Column:
    """Whitespace trim on both ends (tabs and CR included)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blocks_of(source_files: DataFrame, size: int | None = None) -> DataFrame:
    """(project, path, block, first, L): up to ``size`` lines of a file and the two that follow; ``first`` is the
    0-based number of the first."""
    size = size or BLOCK
    cut = source_files.select(*FILE, F.split("content", "\n", -1).alias("L"))
    at = F.sequence(F.lit(0), F.floor((F.size("L") - 1) / size).cast("int"))
    return cut.select(*FILE, "L", F.explode(at).alias("block")).select(
        *FILE, "block", (F.col("block") * size).alias("first"), F.slice("L", F.col("block") * size + 1, F.lit(size + 2)).alias("L"), F.lit(size).alias("size"))


def lines_of(source_files: DataFrame, size: int | None = None) -> DataFrame:
    """(project, path, block, line_no, line, n1, n2): one row per ``\\n``-separated line, 1-based, with the two lines
    after it (null past the end of the file)."""
    own = F.slice("L", F.lit(1), F.col("size"))
    rows = F.transform(own, lambda line, i: F.struct((F.col("first") + i + 1).alias("line_no"), line.alias("line"), F.get("L", i + 1).alias("n1"), F.get("L", i + 2).alias("n2")))
    return blocks_of(source_files, size).select(*FILE, "block", F.inline(rows))


def declarations(lines: DataFrame) -> DataFrame:
    """Column-0 functions, classes and variables (X1-X3, F15), one row each, with
    ``rule`` (0 def, 1 class, 2 variable) ordering rows of the same line."""
    line = F.col("line")
    fn = F.regexp_extract(line, DEF_RE, 1)
    cls = F.regexp_extract(line, CLASS_RE, 1)
    var = F.regexp_extract(line, VAR_RE, 1)
    is_var = ((var != "") & ~line.startswith("def ") & ~line.startswith("class ") & ~line.startswith("#")
              & ~line.startswith(" ") & ~line.startswith("\t") & ~var.isin(VAR_STOP_WORDS))
    trimmed = _trim(line)
    fn_sig = F.regexp_replace(F.regexp_replace(trimmed, r"^def\s+", ""), r":\s*$", "")
    cls_sig = F.regexp_replace(trimmed, r":\s*$", "")
    none = F.lit(None).cast("string")
    cands = F.array(
        F.struct(F.lit(0).alias("rule"), fn.alias("name"), F.lit("function").alias("type"), fn_sig.alias("signature"), (fn != "").alias("hit")),
        F.struct(F.lit(1).alias("rule"), cls.alias("name"), F.lit("class").alias("type"), cls_sig.alias("signature"), (cls != "").alias("hit")),
        F.struct(F.lit(2).alias("rule"), var.alias("name"), F.lit("variable").alias("type"), none.alias("signature"), is_var.alias("hit")),
    )
    return (lines.where(line.rlike(r"^(def|class|[a-zA-Z_])"))
            .select(*FILE, "block", "line_no", "n1", "n2", F.inline(F.filter(cands, lambda c: c["hit"])))
            .drop("hit"))


def _closing_lines(openers: DataFrame, lines: DataFrame) -> DataFrame:
    """``openers`` (project, path, block, line_no, o_no, q, ...) with ``c_no``, the next line after ``o_no`` that holds
    ``q``; null if none does."""
    has = F.filter(F.array(*[F.when(F.instr("line", q) > 0, F.lit(q)) for q in QUOTES]), lambda q: q.isNotNull())
    quotes = lines.select(*FILE, "block", "line_no", F.explode(has).alias("q"))
    # In the opener's own block: lines from the last to the first, an opener before the quote on its own line.
    both = openers.select(*FILE, "o_block", "q", F.col("o_no").alias("at"), F.lit(1).alias("opens")).withColumnRenamed("o_block", "block").unionByName(
        quotes.select(*FILE, "block", "q", F.col("line_no").alias("at"), F.lit(0).alias("opens"))).distinct()
    down = Window.partitionBy(*FILE, "block", "q").orderBy(F.col("at").desc(), F.col("opens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    here = both.withColumn("near", F.min(F.when(F.col("opens") == 0, F.col("at"))).over(down)).where("opens = 1").select(
        *FILE, F.col("block").alias("o_block"), "q", F.col("at").alias("o_no"), "near")
    # In later blocks: one row per block and quote.
    firsts = quotes.groupBy(*FILE, "q", "block").agg(F.min("line_no").alias("m"))
    firsts = firsts.unionByName(openers.select(*FILE, "q", F.col("o_block").alias("block"), F.lit(None).cast("int").alias("m"))).groupBy(*FILE, "q", "block").agg(F.min("m").alias("m"))
    later = Window.partitionBy(*FILE, "q").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(*FILE, "q", F.col("block").alias("o_block"), F.min("m").over(later).alias("far"))
    return openers.join(here, [*FILE, "o_block", "q", "o_no"]).join(firsts, [*FILE, "o_block", "q"]).withColumn("c_no", F.coalesce("near", "far")).drop("near", "far")


def docstrings(source_files: DataFrame, lines: DataFrame, size: int | None = None) -> DataFrame:
    """Docstrings that span lines (X4), of ``declarations`` rows whose opener has no closing quote on its own line:
    the text up to the next line holding that quote (or EOF), trimmed; empty -> null."""
    size = size or BLOCK
    openers = _opened(declarations(lines).where("type <> 'variable'")).where("q <> '' and close_at = 0").select(*FILE, "line_no", "o_no", "q", "rest").distinct()
    openers = stored(openers.withColumn("o_block", F.floor((F.col("o_no") - 1) / size).cast("int")))
    if openers.isEmpty():
        return openers.select(*FILE, "line_no", F.lit(None).cast("string").alias("body"))
    d = _closing_lines(openers, lines)
    ends = blocks_of(source_files, size).join(openers.select(*FILE).distinct(), FILE, "left_semi").groupBy(*FILE).agg(F.max("block").alias("last_block"))
    d = d.join(ends, FILE)
    # A body meets each block it touches, and is joined from their slices in order.
    touched = F.sequence(F.floor(F.col("o_no") / size).cast("int"), F.greatest(F.floor(F.col("o_no") / size).cast("int"), F.coalesce(F.floor((F.col("c_no") - 1) / size).cast("int"), F.col("last_block"))))
    specs = d.select(*FILE, "line_no", "o_no", "c_no", "q", "rest", F.explode(touched).alias("block"))
    own = F.slice("L", F.lit(1), F.col("size"))
    lo = F.greatest(F.col("o_no") - F.col("first"), F.lit(0))
    between = F.slice(own, lo + 1, F.greatest(F.least(F.coalesce(F.col("c_no") - 1, F.lit((1 << 31) - 1)) - F.col("first"), F.size(own)) - lo, F.lit(0)))
    last = F.get("L", F.col("c_no") - 1 - F.col("first"))
    closes = F.col("c_no").between(F.col("first") + 1, F.col("first") + F.size(own))
    closing = F.when(closes, F.array(F.substr(last, F.lit(1), F.position(F.col("q"), last) - 1))).otherwise(F.array().cast("array<string>"))
    pieces = specs.join(blocks_of(source_files, size), [*FILE, "block"]).select(*FILE, "line_no", "block", "rest", F.concat(between, closing).alias("piece"))
    body = pieces.groupBy(*FILE, "line_no").agg(F.first("rest").alias("rest"), F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("ps"))
    text = F.array_join(F.concat(F.array("rest"), F.flatten(F.transform("ps", lambda p: p["piece"]))), "\n")
    return body.select(*FILE, "line_no", F.nullif(_trim(text), F.lit("")).alias("body"))


def _opened(decls: DataFrame) -> DataFrame:
    """``decls`` with the docstring that may open in the next two lines: the first non-blank of them (``o_no`` its
    number), its quote ``q`` (empty if none), what follows the quote, and where it closes there (0 if it doesn't)."""
    t1, t2 = _trim(F.col("n1")), _trim(F.col("n2"))
    use1 = F.col("n1").isNotNull() & (t1 != "")
    use2 = ~use1 & F.col("n2").isNotNull() & (t2 != "")
    opener = F.coalesce(F.when(use1, t1).when(use2, t2), F.lit(""))
    d = decls.withColumns({"opener": opener, "o_no": F.when(use1, F.col("line_no") + 1).when(use2, F.col("line_no") + 2),
                           "q": F.regexp_extract(opener, r"""^(["']{3}|["'])""", 1)})
    d = d.withColumn("rest", F.expr("substring(opener, length(q) + 1)"))
    return d.withColumn("close_at", F.when(F.col("q") != "", F.instr("rest", F.col("q"))).otherwise(F.lit(0)))


def python_elements(source_files: DataFrame, size: int | None = None) -> DataFrame:
    """Elements of Python files in line order (X1-X4, X17). Docstring of a declaration: the first non-blank of the
    next two lines must open with a quote; single-line -> text up to the closing quote; else ``docstrings``."""
    lines = lines_of(source_files, size)
    e = _opened(declarations(lines))
    single = F.when(F.col("close_at") > 0, F.nullif(_trim(F.expr("substring(rest, 1, close_at - 1)")), F.lit("")))
    e = e.select(*FILE, "block", "line_no", "rule", "name", "type", "signature", single.alias("doc_comment"))
    e = e.join(docstrings(source_files, lines, size), [*FILE, "line_no"], "left")
    e = numbered(e, FILE, ["block"], ["line_no", "rule"], "elem_ord")
    return e.select(
        *FILE, "elem_ord", F.concat("path", F.lit(":"), "name").alias("id"), "name", "type", F.col("line_no").cast("int").alias("line"),
        "signature",
        F.when(F.col("type") != "variable", F.coalesce("doc_comment", "body")).alias("doc_comment"),
        (~F.col("name").startswith("_")).alias("exported"))


def python_imports(lines: DataFrame) -> DataFrame:
    """Import edges (X5): ``from M import a, b as c`` -> one per name (alias dropped);
    ``import a, b`` -> one per module with no element. Target = dots to slashes + .py."""
    t = _trim(F.col("line"))
    mod = F.regexp_extract(t, FROM_IMPORT_RE, 1)
    names = F.regexp_extract(t, FROM_IMPORT_RE, 2)
    plain = F.regexp_extract(t, IMPORT_RE, 1)
    first_of = lambda x: F.element_at(F.split(_trim(x), r"\s+as\s+"), 1)
    nm = F.filter(F.transform(F.split(names, ","), first_of), lambda x: x != "")
    mods = F.filter(F.transform(F.split(plain, ","), first_of), lambda x: x != "")
    from_rows = F.transform(nm, lambda n: F.struct(mod.alias("module"), n.alias("name")))
    plain_rows = F.transform(mods, lambda m: F.struct(m.alias("module"), F.lit(None).cast("string").alias("name")))
    rows = F.when(mod != "", from_rows).when(plain != "", plain_rows)
    return (lines.where(t.rlike(r"^(from|import)\s"))
            .select(*FILE, "block", "line_no", F.posexplode(rows).alias("pos", "imp"))
            .select(*FILE, "block", "line_no", "pos", "imp.module", "imp.name"))


def python_bases(lines: DataFrame) -> DataFrame:
    """Inheritance (X7): single-line ``class A(B, C)``; ``object`` and blanks dropped."""
    cls = F.regexp_extract("line", BASES_RE, 1)
    bases = F.filter(F.transform(F.split(F.regexp_extract("line", BASES_RE, 2), ","), _trim),
                     lambda b: (b != "") & (b != "object"))
    return (lines.where(F.col("line").startswith("class"))
            .select(*FILE, "block", "line_no", cls.alias("class_name"), bases.alias("bases"))
            .where(F.col("class_name") != "")
            .select(*FILE, "block", "line_no", "class_name", F.posexplode("bases").alias("pos", "base")))


def python_calls(lines: DataFrame) -> DataFrame:
    """Calls with the running caller scope."""
    line = F.col("line")
    m_indent = F.regexp_extract(line, SCOPE_DEF_RE, 1)
    m_name = F.regexp_extract(line, SCOPE_DEF_RE, 2)
    is_def = m_name != ""
    sets = is_def & (F.length(m_indent).isin(0, 4))
    resets = ((F.length(line) > 0) & ~line.startswith(" ") & ~line.startswith("\t") & ~is_def
              & ~line.rlike(r"^class\s+"))
    marker = F.when(sets, F.struct(m_name.alias("caller"))).when(resets, F.struct(F.lit(None).cast("string").alias("caller")))
    callees = F.filter(F.regexp_extract_all(line, F.lit(CALL_RE), 1), lambda c: ~c.isin(CALL_STOP_WORDS))
    # Thin rows: the line's marker comes before its calls.
    events = lines.select(*FILE, "block", "line_no", marker.alias("marker"), callees.alias("callees")).where(F.col("marker").isNotNull() | (F.size("callees") > 0))
    here = Window.partitionBy(*FILE, "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("scope", F.last("marker", ignorenulls=True).over(here))
    ends = events.groupBy(*FILE, "block").agg(F.max_by("marker", F.when(F.col("marker").isNotNull(), F.col("line_no"))).alias("end"))
    before = Window.partitionBy(*FILE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*FILE, "block", F.last("end", ignorenulls=True).over(before).alias("carried"))
    scoped = events.where(F.size("callees") > 0).join(carried, [*FILE, "block"])
    return scoped.select(*FILE, "block", "line_no", F.coalesce("scope", "carried")["caller"].alias("caller"), F.posexplode("callees").alias("pos", "callee"))


def python_edges(source_files: DataFrame, size: int | None = None) -> DataFrame:
    """Edges of Python files (X5-X7, X18): file by file; in a file imports, then inheritance, then calls."""
    lines = lines_of(source_files, size)

    def part(rows: DataFrame, section: int, kind: str, dst, from_, to) -> DataFrame:
        return rows.select("project", F.col("path").alias("src_path"), dst.alias("dst_path"), F.lit(kind).alias("type"),
                           from_.alias("from_element"), to.alias("to_element"), F.lit(section).alias("_section"), "block", "line_no", "pos")

    own, none = F.col("path"), F.lit(None).cast("string")
    rows = (part(python_imports(lines), 0, "import", module_to_path("module"), none, F.col("name"))
            .unionByName(part(python_bases(lines), 1, "extends", own, F.col("class_name"), F.col("base")))
            .unionByName(part(python_calls(lines), 2, "call", own, F.col("caller"), F.col("callee"))))
    rows = numbered(stored(rows), ["project"], ["src_path", "_section", "block"], ["line_no", "pos"], "edge_ord")
    return rows.select("project", "edge_ord", "src_path", "dst_path", "type", "from_element", "to_element")
