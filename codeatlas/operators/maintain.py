"""Documentation-table updates as new DataFrames (M1-M6, A10).

Each operator takes the current ``docs`` and a batch of changes (with a
``change_ord``) and returns ``(new_docs, statuses)``. Lookups see the table as it
was before the batch; several changes to one key apply in ``change_ord`` order
(the last content wins). The caller writes ``new_docs`` as a new table version
(never reading and overwriting the same path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.functions.text import markdown_body
from codeatlas.operators.docs import DOC_COLS, doc_lookup, resolve_targets
from codeatlas.plans.partitioning import lag_in_order, running_total

# Default body of a new free page.
DEFAULT_PAGE_BODY = "Add documentation here."


def _now(now) -> Column:
    return F.current_timestamp() if now is None else (F.lit(now).cast("timestamp") if not isinstance(now, Column) else now)


def _first_per_element(docs: DataFrame) -> DataFrame:
    """The row an element-keyed update touches: the first one in table order."""
    return docs.groupBy("project", "element").agg(F.min("doc_ord").alias("doc_ord"))


def _next_ord(docs: DataFrame) -> DataFrame:
    return docs.groupBy("project").agg((F.max("doc_ord") + 1).alias("_base"))


def _append_ord(changes_first_ord: Column) -> Column:
    # new rows go after the table, in change order
    return F.coalesce(F.col("_base"), F.lit(0)) + changes_first_ord


def _upsert(docs: DataFrame, rows: DataFrame, keep_cols: list[str]) -> DataFrame:
    """Replace rows of ``docs`` having the same (project, doc_ord) as ``rows``; append the rest."""
    rest = docs.join(rows.select("project", "doc_ord"), ["project", "doc_ord"], "left_anti")
    return rest.select(*DOC_COLS).unionByName(rows.select(*DOC_COLS))


def doc_add(files: DataFrame, elements: DataFrame, docs: DataFrame, changes: DataFrame, now=None):
    """Upsert docs keyed by element (M1, J2, C25). The target's path and type come
    from the architecture (file before its children), else from the extension rule.
    An update keeps ``created_at`` and drops ``aliases`` and ``source`` (a fresh
    entry); empty content is rejected."""
    ts = _now(now)
    ch = changes.select("project", "change_ord", "element", "content")
    valid = ch.where(F.coalesce(F.col("content"), F.lit("")) != "")
    last = valid.groupBy("project", "element").agg(
        F.max_by("content", "change_ord").alias("content"), F.min("change_ord").alias("first_ord"))
    target = resolve_targets(files, elements, last.select("project", F.col("element").alias("name"))) \
        .withColumnRenamed("name", "element")
    hit = _first_per_element(docs).join(docs.select("project", "doc_ord", F.col("created_at").alias("_created")),
                                        ["project", "doc_ord"])
    rows = (last.join(target, ["project", "element"]).join(hit, ["project", "element"], "left")
            .join(_next_ord(docs), "project", "left"))
    rows = rows.select(
        "project", F.coalesce("doc_ord", _append_ord(F.col("first_ord"))).alias("doc_ord"), "element", "path", "type",
        "content", markdown_body("element", "content").alias("markdown"),
        F.lit(None).cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("source"),
        F.coalesce("_created", ts).alias("created_at"), ts.alias("updated_at"),
        F.col("_created").isNotNull().alias("_existed"))
    existed = rows.select("project", "element", "_existed")
    statuses = (ch.join(existed, ["project", "element"], "left")
                .join(last.select("project", "element", "first_ord"), ["project", "element"], "left")
                .select("project", "change_ord", "element",
                        F.when(F.coalesce(F.col("content"), F.lit("")) == "", F.lit("content_required"))
                        .when(F.col("_existed") | (F.col("change_ord") != F.col("first_ord")), F.lit("updated"))
                        .otherwise(F.lit("added")).alias("status")))
    return _upsert(docs, rows.drop("_existed"), DOC_COLS), statuses


def doc_create(docs: DataFrame, changes: DataFrame, now=None):
    """Create or replace free pages (M2): type ``page``, empty path, default body when
    no content; a replaced page gets a new ``created_at`` and loses aliases/source.
    The stored markdown is the content itself."""
    ts = _now(now)
    ch = changes.select("project", "change_ord", F.col("name").alias("element"), "content")
    body = F.coalesce(F.nullif("content", F.lit("")),
                      F.concat(F.lit("# "), F.col("element"), F.lit("\n\n" + DEFAULT_PAGE_BODY + "\n")))
    last = ch.groupBy("project", "element").agg(F.max_by(body, "change_ord").alias("content"),
                                                F.min("change_ord").alias("first_ord"))
    rows = (last.join(_first_per_element(docs), ["project", "element"], "left")
            .join(_next_ord(docs), "project", "left")
            .select("project", F.coalesce("doc_ord", _append_ord(F.col("first_ord"))).alias("doc_ord"), "element",
                    F.lit("").alias("path"), F.lit("page").alias("type"), "content", F.col("content").alias("markdown"),
                    F.lit(None).cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("source"),
                    ts.alias("created_at"), ts.alias("updated_at")))
    statuses = ch.select("project", "change_ord", "element", F.lit("created").alias("status"))
    return _upsert(docs, rows, DOC_COLS), statuses


def doc_alias(docs: DataFrame, changes: DataFrame, now=None):
    """Add aliases (M3): target = first doc whose element or aliases match (J3);
    statuses ``not_found`` / ``already_exists`` / ``added``; an added alias is
    appended and touches ``updated_at``."""
    ts = _now(now)
    ch = changes.select("project", "change_ord", "element", "alias")
    tgt = doc_lookup(docs, ch.select("project", F.col("element").alias("name"))) \
        .select("project", F.col("name").alias("element"), "doc_ord", F.coalesce("aliases", F.array().cast("array<string>")).alias("_old"))
    c = ch.join(tgt, ["project", "element"], "left")
    w = Window.partitionBy("project", "doc_ord", "alias").orderBy("change_ord")
    c = c.withColumn("_dup", F.when(F.col("doc_ord").isNotNull(), F.row_number().over(w) > 1))
    status = (F.when(F.col("doc_ord").isNull(), F.lit("not_found"))
              .when(F.array_contains("_old", F.col("alias")) | F.col("_dup"), F.lit("already_exists"))
              .otherwise(F.lit("added")))
    c = c.withColumn("status", status)
    added = (c.where(F.col("status") == "added")
             .groupBy("project", "doc_ord")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("change_ord", "alias"))), lambda s: s["alias"]).alias("_new")))
    rows = (docs.join(added, ["project", "doc_ord"])
            .withColumn("aliases", F.concat(F.coalesce("aliases", F.array().cast("array<string>")), "_new"))
            .withColumn("updated_at", ts).drop("_new"))
    return _upsert(docs, rows, DOC_COLS), c.select("project", "change_ord", "element", "alias", "status")


def doc_save(docs: DataFrame, changes: DataFrame, now=None):
    """Save edited content (M5): an existing entry changes only content and
    ``updated_at`` (aliases and source kept); a new name becomes a free page. The
    markdown carries a type / path / updated header."""
    ts = _now(now)
    ch = changes.select("project", "change_ord", "element", "content")
    last = ch.groupBy("project", "element").agg(F.max_by("content", "change_ord").alias("_content"),
                                                F.min("change_ord").alias("first_ord"))
    cur = _first_per_element(docs).join(docs, ["project", "element", "doc_ord"])
    upd = last.join(cur, ["project", "element"]).withColumn("content", F.col("_content")).withColumn("updated_at", ts)
    new = (last.join(cur.select("project", "element"), ["project", "element"], "left_anti")
           .join(_next_ord(docs), "project", "left")
           .select("project", _append_ord(F.col("first_ord")).alias("doc_ord"), "element", F.lit("").alias("path"),
                   F.lit("page").alias("type"), F.col("_content").alias("content"), F.lit(None).cast("string").alias("markdown"),
                   F.lit(None).cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("source"),
                   ts.alias("created_at"), ts.alias("updated_at")))
    rows = upd.select(*DOC_COLS).unionByName(new.select(*DOC_COLS))
    header = F.concat(F.lit("# "), F.col("element"), F.lit("\n\n**Type:** "), F.col("type"), F.lit("  \n**Path:** "),
                      F.coalesce(F.nullif("path", F.lit("")), F.lit("N/A")), F.lit("  \n**Updated:** "),
                      F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("\n\n"), F.col("content"), F.lit("\n"))
    rows = rows.withColumn("markdown", header)
    statuses = ch.select("project", "change_ord", "element", F.lit("updated").alias("status"))
    return _upsert(docs, rows, DOC_COLS), statuses


def seed_docs(elements: DataFrame, docs: DataFrame, now=None):
    """Seed docs from doc comments (M4, A10). Per element name, in (path, elem_ord)
    order (a range-partitioned lag, so one very common name is not one task): a
    manual entry (source not ``auto``) skips every row; otherwise a row is
    ``created`` when its comment differs from the previous state (the stored auto
    content, then the previous row's comment), else ``skipped``. The final entry of a
    name is its last created row (path and type from it), source ``auto``,
    ``created_at`` kept when the name existed. The result keeps one entry per
    element (the table is re-keyed by element, first position, last value).

    Returns (new_docs, counts(project, created, skipped), actions)."""
    ts = _now(now)
    keyed = docs.groupBy("project", "element").agg(
        F.min("doc_ord").alias("doc_ord"), F.max_by(F.struct(*[c for c in DOC_COLS if c not in ("project", "element", "doc_ord")]),
                                                    "doc_ord").alias("v"))
    base = keyed.select("project", "element", "doc_ord", "v.*")
    st = base.select("project", F.col("element").alias("name"), F.col("source").alias("_src"),
                     F.col("content").alias("_stored"), F.col("created_at").alias("_created"), F.lit(True).alias("_exists"))
    el = elements.where(F.coalesce(F.col("doc_comment"), F.lit("")) != "").select(
        "project", "name", "path", "elem_ord", "type", F.col("doc_comment").alias("c"))
    a = lag_in_order(el.join(st, ["project", "name"], "left"), ["project", "name"], ["path", "elem_ord"], "c", "_lag")
    manual = F.coalesce(F.col("_exists"), F.lit(False)) & F.coalesce(F.col("_src") != "auto", F.lit(True))
    prev = F.coalesce(F.col("_lag"), F.when(F.col("_src") == "auto", F.col("_stored")))
    a = a.withColumn("action", F.when(manual, F.lit("skipped"))
                     .when(prev.isNotNull() & (prev == F.col("c")), F.lit("skipped")).otherwise(F.lit("created")))
    counts = a.groupBy("project").agg(F.count_if(F.col("action") == "created").alias("created"),
                                      F.count_if(F.col("action") == "skipped").alias("skipped"))
    final = (a.where(F.col("action") == "created").groupBy("project", "name")
             .agg(F.max_by(F.struct("path", "type", "c", "_created"), F.struct("path", "elem_ord")).alias("f"),
                  F.min(F.struct("path", "elem_ord")).alias("_first")))
    ords = _next_ord(docs)
    rows = (final.join(base.select("project", F.col("element").alias("name"), "doc_ord"), ["project", "name"], "left")
            .join(ords, "project", "left"))
    # Names new to the table are appended in first-creation order.
    fresh = rows.where(F.col("doc_ord").isNull()).withColumns({"_file": F.col("_first.path"), "_at": F.col("_first.elem_ord"), "_one": F.lit(1).cast("long")})
    new = running_total(fresh, ["project"], ["_file", "_at"], "_one", "_mono").select(*rows.columns, "_mono")
    old = rows.where(F.col("doc_ord").isNotNull()).withColumn("_mono", F.lit(None).cast("long"))
    rows = old.unionByName(new).select(
        "project", F.coalesce("doc_ord", F.coalesce("_base", F.lit(0)) + F.col("_mono")).alias("doc_ord"),
        F.col("name").alias("element"), F.col("f.path").alias("path"), F.col("f.type").alias("type"),
        F.col("f.c").alias("content"), markdown_body(F.col("name"), F.col("f.c")).alias("markdown"),
        F.lit(None).cast("array<string>").alias("aliases"), F.lit("auto").alias("source"),
        F.coalesce(F.col("f._created"), ts).alias("created_at"), ts.alias("updated_at"))
    new_docs = _upsert(base.select(*DOC_COLS), rows, DOC_COLS)
    return new_docs, counts, a.select("project", "name", "path", "elem_ord", "action")


def markdown_moves(old_docs: DataFrame, new_docs: DataFrame) -> DataFrame:
    """Retype cleanup (M6): markdown locations to delete because an element's type
    folder changed, as rows (project, element, old md_path, new md_path)."""
    from codeatlas.operators.docs import with_markdown
    o = with_markdown(old_docs).select("project", "doc_ord", "element", F.col("md_path").alias("old_md_path"))
    n = with_markdown(new_docs).select("project", "doc_ord", "element", F.col("md_path").alias("new_md_path"))
    return o.join(n, ["project", "doc_ord", "element"]).where(F.col("old_md_path") != F.col("new_md_path"))
