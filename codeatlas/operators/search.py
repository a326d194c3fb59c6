"""Typo-tolerant ranked search over code and docs.

Short columns (paths, names, signatures, aliases) are scored with the native expression of
:func:`codeatlas.functions.score.score_match`. Long text (doc content) is scored from a stored
:class:`codeatlas.operators.search_index.SearchIndex`, or, without one, in a single pass over the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.score import MIN_SCORE, SCORE_CONTAINS, SCORE_EQUAL, hits_score, near, score_match, tokenize, tokenize_py
from codeatlas.functions.text import location
from codeatlas.operators.search_index import SearchIndex
from codeatlas.plans.partitioning import running_total
from codeatlas.plans.topk import top_k


def content_token_scores(docs: DataFrame, query: str, text_col: str = "content", key_cols=("project", "doc_ord")) -> DataFrame:
    """Token scores of long texts in one pass over them: each document's distinct tokens are matched against the few
    query tokens in generated code, and only near ones are shuffled. Documents without any are absent (score 0)."""
    asked = tokenize_py(query)
    tokens = docs.select(*key_cols, F.explode(F.array_distinct(tokenize(text_col))).alias("token"))
    t = F.col("token")
    found = F.filter(F.array(*[F.struct(F.lit(i).alias("q_pos"), (t == q).alias("exact"), near(t, q).alias("near")) for i, q in enumerate(asked)]), lambda s: s["near"])
    hits = tokens.select(*key_cols, F.explode(found).alias("m")).select(*key_cols, "m.q_pos", "m.exact") if asked else \
        tokens.where(F.lit(False)).select(*key_cols, F.lit(0).alias("q_pos"), F.lit(False).alias("exact"))
    return hits_score(hits, list(key_cols), len(asked))


def long_text_score(docs: DataFrame, query: str, index: SearchIndex | None = None,
                    text_col: str = "content", key_cols=("project", "doc_ord")) -> DataFrame:
    """``docs`` without its text, plus ``content_score`` = score_match(query, text): from the stored index, or in one
    pass over the texts."""
    key_cols = list(key_cols)
    if not query:
        return docs.withColumn("content_score", F.lit(0.0)).drop(text_col)
    if index is not None:
        found = docs.drop(text_col).join(index.content_scores(query), key_cols, "left")
        return found.withColumn("content_score", F.coalesce("content_score", F.lit(0.0)))
    q = query.lower().strip()
    t = F.col(text_col)
    ts = content_token_scores(docs, query, text_col, key_cols)
    # What the whole text decides is decided in the scan; only a number goes on to the join.
    whole = (F.when(t.isNull() | (t == ""), F.lit(0.0))
             .when(F.lower(t) == F.lit(q), F.lit(SCORE_EQUAL))
             .when(F.lower(t).contains(F.lit(q)), F.lit(SCORE_CONTAINS)))
    thin = docs.withColumn("_whole", whole).drop(text_col)
    j = thin.join(ts, key_cols, "left")
    return j.withColumn("content_score", F.coalesce("_whole", "tok_score", F.lit(0.0))).drop("tok_score", "_whole")


def _alias_score(query: str) -> F.Column:
    return F.coalesce(F.array_max(F.transform(F.coalesce("aliases", F.array().cast("array<string>")),
                                              lambda a: score_match(query, a))), F.lit(0.0))


def doc_hits(docs: DataFrame, query: str, with_path: bool = False, index: SearchIndex | None = None) -> DataFrame:
    """Doc score: max(element, best alias, 0.5*content[, 0.7*path])."""
    d = long_text_score(docs, query, index)
    parts = [score_match(query, F.col("element")), _alias_score(query), F.col("content_score") * 0.5]
    if with_path:
        parts.append(score_match(query, F.col("path")) * 0.7)
    return d.withColumn("score", F.greatest(*parts)).drop("content_score")


def code_hits(files: DataFrame, elements: DataFrame, query: str) -> DataFrame:
    """File hits score the path; element hits take max(name, 0.8*signature) (C4)."""
    f = files.select("project", F.col("name").alias("element"), F.lit("file").alias("type"),
                     F.col("path").alias("location"), F.lit("code").alias("source"),
                     F.lit(None).cast("string").alias("signature"),
                     score_match(query, F.col("path")).alias("score"),
                     F.struct(F.lit(0).alias("s"), F.col("path").alias("p"), F.lit(-1).cast("long").alias("o")).alias("ord"))
    # Elements are thin and scoring them isn't: dealt out first, as one split of a file may hold millions.
    e = elements.repartition("project", "path", "elem_ord").select("project", F.col("name").alias("element"), "type",
                        location("path", "line").alias("location"), F.lit("code").alias("source"), "signature",
                        F.greatest(score_match(query, F.col("name")),
                                   score_match(query, F.coalesce("signature", F.lit(""))) * 0.8).alias("score"),
                        F.struct(F.lit(0).alias("s"), F.col("path").alias("p"), F.col("elem_ord").cast("long").alias("o")).alias("ord"))
    return f.unionByName(e)


def search(files: DataFrame, elements: DataFrame, docs: DataFrame, query: str, k: int = 25,
           min_score: float = MIN_SCORE, index: SearchIndex | None = None) -> DataFrame:
    """Unified search (U1, J8, F8, T1, C7): code and doc hits with score >= 0.3,
    one row per (element, location) keeping the best score (code first on ties),
    top ``k`` per project by score, rounded to 3 decimals."""
    code = code_hits(files, elements, query)
    docs = docs.select("project", "doc_ord", "element", "type", "path", "aliases", "content")
    d = doc_hits(docs, query, index=index).select(
        "project", "element", "type",
        F.when(F.coalesce("path", F.lit("")) == "", F.lit(None).cast("string")).otherwise(F.col("path")).alias("location"),
        F.lit("doc").alias("source"), F.lit(None).cast("string").alias("signature"), "score",
        F.struct(F.lit(1).alias("s"), F.lit("").alias("p"), F.col("doc_ord").cast("long").alias("o")).alias("ord"))
    hits = code.unionByName(d).where(F.col("score") >= min_score)
    # best per (element, location); null locations compare equal inside a group key
    best = (hits.groupBy("project", "element", "location")
            .agg(F.min_by(F.struct("type", "source", "signature", "score", "ord"),
                           F.struct((-F.col("score")).alias("neg"), F.col("ord"))).alias("b")))
    flat = best.select("project", "element", "location", "b.*")
    ranked = top_k(flat, "project", [F.col("score").desc(), F.col("ord"), F.col("element"),
                                     F.col("location").asc_nulls_first()], k)
    return ranked.select("project", "rank", "element", "type", "location", "source", "signature",
                         F.round("score", 3).alias("score"))


def doc_search(docs: DataFrame, query: str, min_score: float = MIN_SCORE,
               index: SearchIndex | None = None) -> DataFrame:
    """Doc search (C6, T2): every doc scoring >= 0.3 on max(element, alias,
    0.7*path, 0.5*content), ranked by score then table order; score rounded."""
    docs = docs.select("project", "doc_ord", "element", "type", "path", "aliases", "content")
    d = doc_hits(docs, query, with_path=True, index=index).where(F.col("score") >= min_score)
    # A total order of hits of any number: ranges of (score, place) and a running count over them.
    d = running_total(d.withColumns({"_neg": -F.col("score"), "_one": F.lit(1).cast("long")}), ["project"], ["_neg", "doc_ord"], "_one", "_before")
    return d.select("project", (F.col("_before") + 1).alias("rank"), "doc_ord", "element", "type", "path", "aliases", F.round("score", 3).alias("score"))
