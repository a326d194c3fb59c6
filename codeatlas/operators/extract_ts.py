"""TS/JS source text -> elements and edges (X8-X16, X14, C17) without a syntax tree.

One pass over each text (``functions/tslex.py``) yields its declaring, importing and exporting statements with
their *skeletons* -- comments blank, everything inside nested brackets, type arguments and strings cut -- and the
called names with the function declaration around them. All rules are expressions over skeletons:

1. a declaration's name, parameters, return type and heritage are groups of a pattern over its skeleton; their
   wording is cut out of the statement as written, by the groups' places;
2. declarators, parameters and implemented types are split at the commas that the skeleton has left;
3. elements and edges of a file are numbered by their place in the file's own list, so no window ever holds a file.

A long text is cut into blocks at lines that can only start a statement, and all blocks are read at the same time as
if each began at the top level. That is right wherever the block before ends with nothing open, which its own pass
tells; a block that doesn't is read again together with those after it, twice as many each round, until all agree.
So a file of any length is read by many tasks, and the result is that of one pass. After it rows are thin and dealt by no
file key but in the join that resolves imports. Known differences from a full parser: see README.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.functions.text import SOURCE_EXTENSIONS, dirname, normalise_path
from codeatlas.functions.tslex import FILL, SCAN_COLUMNS, block_batches, scan_batches
from codeatlas.plans.partitioning import running_total
from codeatlas.plans.stored import stored

FILE = ["project", "path"]
#: Letters of a text that are read at once, at least.
BLOCK = 1 << 20
ID = r"[A-Za-z_$¡-\x{10ffff}][\w$¡-\x{10ffff}]*"
_HEAD = r"(?s)^((?:@.*?\s)?(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
_INNER = rf"(?:[^()]|\({FILL}*\))*"
FUNCTION = _HEAD + rf"function\b\s*\*?\s*({ID})?\s*(?:<{FILL}*>)?\s*\()({_INNER})(\)\s*(?::\s*)?)(.*)$"
CLASS = _HEAD + (rf"class\b)(\s+(?!extends\b|implements\b){ID})?(\s*(?:<{FILL}*>)?)(\s*\bextends\s+)?"
                 r"(?:(?<=extends\s{1,99})((?:(?!\bimplements\b).)*))?(\bimplements\s+)?(.*)$")
NAMED = _HEAD + rf"(?:const\s+)?(?:interface|type|enum)\s+)({ID})"
VARIABLE = r"(?s)^((?:export\s+)?(?:declare\s+)?(?:const|let|var)\b)(.*)$"


def scanned(source_files: DataFrame, size: int = BLOCK) -> DataFrame:
    """(project, path, statements, calls) of each file; texts of more than ``size`` letters are read in blocks."""
    src = source_files.select(*FILE, "content")
    short = src.where(F.coalesce(F.length("content"), F.lit(0)) <= size)
    short = short.mapInArrow(scan_batches, f"project string, path string, {SCAN_COLUMNS}").drop("whole")
    long = src.where(F.length("content") > size)
    if long.isEmpty():
        return short
    return short.unionByName(_in_blocks(long, size))


def _in_blocks(long: DataFrame, size: int) -> DataFrame:
    keys = "project string, path string"
    blocks = stored(long.mapInArrow(block_batches(size), f"{keys}, block int, line int, content string"))
    groups = blocks.select(*FILE, "block", F.col("block").alias("first"))
    done, reach = None, 1
    while True:
        # Texts of the groups that are to be read, put together from their blocks.
        todo = groups if done is None else groups.join(done.select(*FILE, "first", "n"), [*FILE, "first"], "left").withColumn("own", F.count(F.lit(1)).over(Window.partitionBy(*FILE, "first"))).where(
            F.col("n").isNull() | (F.col("n") != F.col("own"))).select(*FILE, "block", "first")
        texts = blocks.join(todo, [*FILE, "block"]).groupBy(*FILE, "first").agg(
            F.sort_array(F.collect_list(F.struct("block", "line", "content"))).alias("b")).select(
            *FILE, "first", F.size("b").alias("n"), F.col("b")[0]["line"].alias("line"), F.array_join(F.transform("b", lambda x: x["content"]), "").alias("content"))
        new = stored(texts.mapInArrow(scan_batches, f"{keys}, first int, n int, line int, {SCAN_COLUMNS}"))
        kept = groups.groupBy(*FILE, "first").agg(F.count(F.lit(1)).cast("int").alias("n"))
        done = new if done is None else stored(done.unionByName(new).join(kept, [*FILE, "first", "n"]))
        # A group stands if the one before it left nothing open; one that did takes those after it in.
        order = Window.partitionBy(*FILE).orderBy("first")
        stands = F.coalesce(F.min(F.col("whole").cast("int")).over(order.rowsBetween(-reach, -1)), F.lit(1)) == 1
        starts = done.select(*FILE, F.col("first").alias("old"), F.max(F.when(stands, F.col("first"))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("first"))
        changed = stored(starts)
        if changed.where("old <> first").isEmpty():
            break
        groups = stored(groups.withColumnRenamed("first", "old").join(changed, [*FILE, "old"]).select(*FILE, "block", "first"))
        reach *= 2
    moved = done.withColumn("statements", F.transform("statements", lambda s: s.withField("line", s["line"] + F.col("line"))))
    parts = moved.groupBy(*FILE).agg(F.sort_array(F.collect_list(F.struct("first", "statements", "calls"))).alias("p"))
    return parts.select(*FILE, F.flatten(F.transform("p", lambda x: x["statements"])).alias("statements"), F.flatten(F.transform("p", lambda x: x["calls"])).alias("calls"))


def _cut(raw: Column, start: Column, text: Column) -> Column:
    """The written form of a stretch of a skeleton that starts at ``start`` (from 0), without white space around it."""
    lead = F.length(F.regexp_extract(text, r"^(\s*)", 1))
    return F.substr(raw, start + lead + 1, F.length(F.regexp_replace(text, r"^\s+|\s+$", "")))


def _listed(raw: Column, start: Column, skeleton: Column) -> Column:
    """The comma-separated parts of a stretch, as written; empty parts go. Entries: text, at (place of the part in ``raw``)."""
    parts = F.split(skeleton, ",", -1)
    at = lambda i: start + F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, p: n + F.length(p) + 1)
    each = F.transform(parts, lambda p, i: F.struct(_cut(raw, at(i), p).alias("text"), (at(i) + F.length(F.regexp_extract(p, r"^(\s*)", 1))).alias("at"), p.alias("skeleton")))
    return F.filter(each, lambda e: e["text"] != "")


def _matched(s: Column, pattern: str, groups: int) -> Column:
    """The statement with the groups of its pattern."""
    return F.struct(s["raw"].alias("raw"), s["skeleton"].alias("skeleton"), s["line"].alias("line"), s["doc"].alias("doc"),
                    *[F.regexp_extract(s["skeleton"], pattern, k).alias(f"g{k}") for k in range(1, groups + 1)])


def _up_to(s: Column, k: int) -> Column:
    """Length of the first ``k`` groups, which follow each other."""
    return sum((F.length(s[f"g{j}"]) for j in range(1, k + 1)), F.lit(0))


def _exported(s: Column) -> Column:
    return s["skeleton"].rlike(r"^(?:@(?s:.*?)\s)?export\b")


def _element(name: Column, kind: str, line: Column, signature: Column, s: Column, exported: Column) -> Column:
    return F.struct(name.alias("name"), F.lit(kind).alias("type"), line.cast("int").alias("line"), signature.cast("string").alias("signature"),
                    s["doc"].alias("doc_comment"), exported.alias("exported"))


def _functions(s: Column) -> Column:
    """Name, parameters joined by a comma and a space, and the declared return type."""
    params = F.array_join(F.transform(_listed(s["raw"], F.length(s["g1"]), s["g3"]), lambda p: p["text"]), ", ")
    tail = F.length(s["g1"]) + F.length(s["g3"]) + F.length(s["g4"])  # the name is a part of the first group
    ret = F.when(s["g4"].contains(":"), _cut(s["raw"], tail, s["g5"])).otherwise("")
    name = F.when(s["g2"] == "", F.lit("<anonymous>")).otherwise(s["g2"])
    signature = F.concat(name, F.lit("("), params, F.lit(")"), F.when(ret != "", F.concat(F.lit(": "), ret)).otherwise(""))
    return F.array(_element(name, "function", s["line"], signature, s, _exported(s)))


def class_name(s: Column) -> Column:
    return F.regexp_replace(s["g2"], r"\s+", "")


def base_class(s: Column) -> Column:
    """The extended expression as written, empty if there is none."""
    return _cut(s["raw"], _up_to(s, 4), s["g5"])


def _classes(s: Column) -> Column:
    """Name and extended class."""
    name = F.when(s["g2"] == "", F.lit("<anonymous>")).otherwise(class_name(s))
    signature = F.concat(F.lit("class "), name, F.when(s["g5"] != "", F.concat(F.lit(" extends "), base_class(s))).otherwise(""))
    return F.array(_element(name, "class", s["line"], signature, s, _exported(s)))


def _named(kind: str):
    """Interfaces, type aliases and enums."""
    def of(s: Column) -> Column:
        signature = F.concat(F.lit("interface "), s["g2"]) if kind == "interface" else F.lit(None)
        return F.array(_element(s["g2"], kind, s["line"], signature, s, _exported(s)))
    return of


def _variables(s: Column) -> Column:
    """One element per declarator; its line is the declarator's own (X11)."""
    def of(d: Column) -> Column:
        name = F.regexp_extract(d["skeleton"], rf"(?s)^\s*(\{{{FILL}*\}}|\[{FILL}*\]|[^\s:=!]+)", 1)
        line = s["line"] + F.length(F.regexp_replace(F.substr(s["raw"], F.lit(1), d["at"]), r"[^\n]+", ""))
        return _element(F.substr(d["text"], F.lit(1), F.length(name)), "variable", line, F.lit(None), s, _exported(s))
    return F.transform(_listed(s["raw"], F.length(s["g1"]), s["g2"]), of)


#: Rule, pattern and number of its groups, by the kind of the statement; in the order of a file's elements.
RULES = {"function": (_functions, FUNCTION, 5), "class": (_classes, CLASS, 7), "interface": (_named("interface"), NAMED, 2),
         "type": (_named("type"), NAMED, 2), "enum": (_named("enum"), NAMED, 2), "variable": (_variables, VARIABLE, 2)}


def _of(kind: str, rule, pattern: str = "", groups: int = 0) -> Column:
    """What a rule makes of a file's top-level statements of a kind."""
    own = F.filter("statements", lambda s: s["top"] & (s["kind"] == kind))
    return F.flatten(F.transform(F.transform(own, lambda s: _matched(s, pattern, groups)), rule))


def exported_names(statements: Column) -> Column:
    """Names that ``export { ... }`` lists without a module, and ``export default name``, export."""
    lists = F.filter(statements, lambda s: (s["kind"] == "export") & ~s["skeleton"].rlike(r"\}\s*from\b"))
    inside = F.flatten(F.transform(lists, lambda s: F.split(F.regexp_extract(s["skeleton"], r"(?s)^export\s*(?:type\s*)?\{(.*?)\}", 1), ",")))
    names = F.transform(inside, lambda n: F.regexp_extract(n, rf"^\s*(?:type\s+(?!as\b))?({ID})", 1))
    default = F.transform(lists, lambda s: F.regexp_extract(s["skeleton"], rf"^export\s+default\s+({ID})\s*$", 1))
    return F.concat(names, default)


def ts_elements(source_files: DataFrame | None, scan: DataFrame | None = None) -> DataFrame:
    """Top-level elements of TS/JS files (X8-X12, X17): functions, classes, interfaces, type aliases, enums,
    variables -- each group in source order. ``scan``: the files' ``scanned`` table, if it is there already."""
    scan = scanned(source_files) if scan is None else scan
    groups = [_of(kind, *rule) for kind, rule in RULES.items()]
    rows = scan.select(*FILE, exported_names(F.col("statements")).alias("listed"), F.posexplode(F.concat(*groups)).alias("place", "e"))
    return rows.select(*FILE, (F.col("place") + 1).cast("long").alias("elem_ord"), F.concat("path", F.lit(":"), "e.name").alias("id"), "e.name", "e.type", "e.line",
                       "e.signature", "e.doc_comment", (F.col("e.exported") | F.array_contains("listed", F.col("e.name"))).alias("exported"))


def _edge(kind: str, to: Column, from_element: Column, to_element: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), to.cast("string").alias("to"), from_element.cast("string").alias("from_element"), to_element.cast("string").alias("to_element"))


def _imports(s: Column) -> Column:
    """Of a statement the named imports, then the default (X13); ``to`` is the specifier."""
    spec = F.regexp_extract(s["skeleton"], r"""(?s)\bfrom\s*['"]([^'"]*)['"]""", 1)
    names = F.split(F.regexp_extract(s["skeleton"], r"(?s)^[^'\"]*?\{([^}]*)\}", 1), ",")
    named = F.filter(F.transform(names, lambda n: F.regexp_extract(n, rf"^\s*(?:type\s+(?!as\b))?({ID})", 1)), lambda n: n != "")
    default = F.regexp_extract(s["skeleton"], rf"^import\s+(?:type\s+(?!from\b|,))?({ID})\s*(?:,|from\b)", 1)
    none = F.lit(None)
    return F.when(spec == "", F.array()).otherwise(F.concat(
        F.transform(named, lambda n: _edge("import", spec, none, n)),
        F.when(default != "", F.array(_edge("import", spec, none, F.lit("default")))).otherwise(F.array())))


def _heritage(s: Column) -> Column:
    """The extended class, then the implemented types."""
    name = F.nullif(class_name(s), F.lit(""))
    none, base = F.lit(None), base_class(s)
    types = F.when(s["g6"] != "", _listed(s["raw"], _up_to(s, 6), s["g7"]))
    return F.concat(F.when(s["g5"] != "", F.array(_edge("extends", none, name, base))).otherwise(F.array()),
                    F.coalesce(F.transform(types, lambda t: _edge("implements", none, name, t["text"])), F.array()))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``dst_path`` of each (project, path, spec) (X14, C17): for a relative specifier the first that exists of the
    exact path, path + each extension, path/index + each extension, then (for a .js/.jsx/.mjs/.cjs specifier) the
    stem + each extension; else the specifier. ``files`` (project, path) are all files that exist in the trees,
    whatever their suffix, scanned or not."""
    base = normalise_path(F.concat(F.when(dirname("path") == "", F.lit("")).otherwise(F.concat(dirname("path"), F.lit("/"))),
                                   F.col("spec")))
    stem = F.regexp_replace(base, r"\.(js|jsx|mjs|cjs)$", "")
    cands = [base] + [F.concat(base, F.lit(e)) for e in SOURCE_EXTENSIONS] + \
            [F.concat(base, F.lit("/index" + e)) for e in SOURCE_EXTENSIONS]
    js = F.col("spec").rlike(r"\.(js|jsx|mjs|cjs)$")
    cands += [F.when(js, F.concat(stem, F.lit(e))) for e in SOURCE_EXTENSIONS]
    rel = imports.where(F.col("spec").startswith(".")).select(*FILE, "spec").distinct()
    c = rel.select(*FILE, "spec", F.posexplode(F.array(*cands)).alias("cpos", "cand")).where(F.col("cand").isNotNull())
    fp = files.select("project", F.col("path").alias("cand")).distinct()
    hit = (c.join(fp, ["project", "cand"]).groupBy(*FILE, "spec").agg(F.min_by("cand", "cpos").alias("resolved")))
    return imports.join(hit, [*FILE, "spec"], "left").withColumn("dst_path", F.coalesce("resolved", "spec")).drop("resolved")


def ts_edges(source_files: DataFrame | None, files: DataFrame | None = None, scan: DataFrame | None = None) -> DataFrame:
    """Edges of TS/JS files (X13-X16, X18): file by file; in a file imports, then inheritance (extends, implements),
    then calls. ``files`` (project, path): the files that imports may name, by default the input files; ``scan``: the
    files' ``scanned`` table, if it is there already."""
    files = files if files is not None else source_files.select(*FILE)
    scan = scanned(source_files) if scan is None else scan
    calls = F.transform("calls", lambda c: _edge("call", F.lit(None), c["caller"], c["callee"]))
    # Thin, and read three times: by the counts, the specifiers and the edges.
    per = stored(scan.select(*FILE, F.concat(_of("import", _imports), _of("class", _heritage, CLASS, 7), calls).alias("edges")).where(F.size("edges") > 0))
    before = running_total(per.select(*FILE, F.size("edges").alias("n")), ["project"], ["path"], "n", "before")
    rows = per.join(before.select(*FILE, "before"), FILE).select(*FILE, "before", F.posexplode("edges").alias("place", "e"))
    rows = rows.select(*FILE, (F.col("before") + F.col("place") + 1).cast("long").alias("edge_ord"), "e.*")
    specs = per.select(*FILE, F.explode("edges").alias("e")).where(F.col("e.type") == "import").select(*FILE, F.col("e.to").alias("spec")).distinct()
    found = resolve_imports(specs, files).where(F.col("dst_path") != F.col("spec")).select(*FILE, F.col("spec").alias("to"), "dst_path")
    rows = rows.join(found, [*FILE, "to"], "left")
    return rows.select("project", "edge_ord", F.col("path").alias("src_path"), F.coalesce("dst_path", "to", "path").alias("dst_path"), "type", "from_element", "to_element")
