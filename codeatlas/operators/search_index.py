"""A stored search index of long texts (C2, C3, C5, C6, T1): written once, queried without reading the texts.

Tables, each bucketed by the hash of what it is looked up by (a query reads the buckets of its own words):

* ``tokens`` (token, document): the distinct tokens of each text.
* ``near`` (key, token): every vocabulary token under its three segments, each with the token's length and the
  segment's number. At most two edits leave one of three segments as it is, shifted by two places at most; so a
  query token looks up its own stretches at those places, for all lengths in reach, and checks the distance of what
  it finds. Tokens of one or two letters have a key of their length alone.
* ``words`` (word, document, place, separators before and after): the words of the lower-cased text in order, for the
  question whether a text contains the query as it is: inner words are exact, the first may be the end of a word, the
  last the beginning of one, and the separators between must be equal. Ends and beginnings are tested where the words
  are read, so only rows that match are ever shuffled.
* ``whole`` (document, SHA-256 of the lower-cased text), for texts equal to the query.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions.score import (SCORE_CONTAINS, SCORE_EQUAL, NON_WORD, PY_NON_WORD, fuzzy_threshold, near, tokenize, tokenize_py,
                                       hits_score)
from codeatlas.plans.stored import stored
from codeatlas.session import run_folder

BUCKETS = 64
#: Segments of a token: one more than the edits that are allowed.
SEGMENTS = 3
KEY = ["project", "doc_ord"]


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def segments(length: int) -> list[tuple[int, int]]:
    """(start, length) of the segments of a token, as even as can be, the longer ones last."""
    size, longer = divmod(length, SEGMENTS)
    sizes = [size + (k >= SEGMENTS - longer) for k in range(SEGMENTS)]
    return [(sum(sizes[:k]), sizes[k]) for k in range(SEGMENTS)]


def keys_of(token: Column) -> Column:
    """The keys that a token is stored under."""
    n = F.length(token)
    size, longer = F.floor(n / SEGMENTS).cast("int"), n % SEGMENTS
    keys, start = [], F.lit(0)
    for k in range(SEGMENTS):
        own = size + F.when(longer >= SEGMENTS - k, 1).otherwise(0)
        keys.append(F.concat_ws(":", n.cast("string"), F.lit(str(k)), F.substr(token, start + 1, own)))
        start = start + own
    return F.when(n < SEGMENTS, F.array(n.cast("string"))).otherwise(F.array(*keys))


def asked_keys(q: str, most: int) -> set[str]:
    """The keys under which tokens within ``most`` edits of ``q`` may be stored."""
    keys = set()
    for n in range(max(1, len(q) - most), len(q) + most + 1):
        if n < SEGMENTS:
            keys.add(str(n))
            continue
        for k, (start, size) in enumerate(segments(n)):
            for at in range(max(0, start - most), min(len(q) - size, start + most) + 1):
                keys.add(f"{n}:{k}:{q[at:at + size]}")
    return keys


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, text: str = "content") -> SearchIndex:
        """Index ``docs`` (project, doc_ord, text) at ``path``, by default in the shared folder."""
        spark = docs.sparkSession
        path = path or f"{run_folder(spark)}/index-{uuid.uuid4().hex}"
        index = cls(spark, path)
        docs = docs.select(*KEY, F.coalesce(F.col(text), F.lit("")).alias("t")).where("t <> ''")
        tokens = docs.select(*KEY, F.explode(F.array_distinct(tokenize("t"))).alias("token"))
        index._write(tokens.withColumn("bucket", _bucket(F.col("token"))), "tokens")
        vocabulary = index.table("tokens").select("token").distinct()
        index._write(vocabulary.select("token", F.explode(keys_of(F.col("token"))).alias("key")).withColumn("bucket", _bucket(F.col("key"))), "near")
        low = docs.select(*KEY, F.lower("t").alias("t"))
        cut = low.select(*KEY, F.split("t", NON_WORD, -1).alias("w"), F.regexp_extract_all("t", F.lit(f"({NON_WORD})"), F.lit(1)).alias("s"))
        words = cut.select(*KEY, "s", F.posexplode("w").alias("place", "word")).select(
            *KEY, "place", "word", F.coalesce(F.get("s", F.col("place") - 1), F.lit("")).alias("before"), F.coalesce(F.get("s", "place"), F.lit("")).alias("after"))
        index._write(words.withColumn("bucket", _bucket(F.col("word"))), "words")
        index._write(low.select(*KEY, F.sha2(F.col("t").cast("binary"), 256).alias("sha")), "whole", by=None)
        return index

    def _write(self, df: DataFrame, name: str, by: str | None = "bucket") -> None:
        if by:  # files of even size, however often a word occurs
            df = df.hint("rebalance", by)
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        kinds = {"tokens": "project string, doc_ord long, token string, bucket int", "near": "token string, key string, bucket int",
                 "words": "project string, doc_ord long, place int, word string, before string, after string, bucket int",
                 "whole": "project string, doc_ord long, sha string"}
        return self.spark.read.schema(kinds[name]).parquet(f"{self.path}/{name}")

    def near_tokens(self, query: str) -> DataFrame:
        """(token, q_pos, exact) of the vocabulary's tokens within the distance of a query token."""
        asked = list(enumerate(tokenize_py(query)))
        keys = [(i, key) for i, q in asked for key in asked_keys(q, fuzzy_threshold(q))]
        rows = self.spark.createDataFrame(keys, "q_pos int, key string").withColumn("bucket", _bucket(F.col("key")))
        found = self.table("near").join(F.broadcast(rows), ["bucket", "key"]).select("token", "q_pos").distinct()  # under 100 keys a query token
        close = exact = F.lit(False)
        for i, q in asked:
            close = F.when(F.col("q_pos") == i, near(F.col("token"), q)).otherwise(close)
            exact = F.when(F.col("q_pos") == i, F.col("token") == q).otherwise(exact)
        return found.withColumn("exact", exact).where(close)

    def token_scores(self, query: str) -> DataFrame:
        """(project, doc_ord, tok_score) of the documents with a token near the query's."""
        # Stored, as only its true size tells the planner that the tokens of all texts needn't be shuffled to meet it.
        found = stored(self.near_tokens(query).withColumn("bucket", _bucket(F.col("token"))))
        hits = self.table("tokens").join(found, ["bucket", "token"])
        return hits_score(hits.select(*KEY, "q_pos", "exact"), KEY, len(tokenize_py(query)))

    def containing(self, q: str) -> DataFrame:
        """(project, doc_ord) of the texts that contain the lower-cased ``q``."""
        if q == "":
            return self.table("whole").select(*KEY)
        words, seps = PY_NON_WORD.split(q), PY_NON_WORD.findall(q)
        last = len(words) - 1
        if last == 1 and words == ["", ""]:  # separators alone
            return self.table("words").where(F.col("after").contains(q)).select(*KEY).distinct()
        parts = []
        for j, w in enumerate(words):
            if w == "":
                continue
            rows = self.table("words")
            word = F.col("word")
            if last == 0:
                rows = rows.where(word.contains(w))
            elif j == 0:
                rows = rows.where(word.endswith(w))
            elif j == last:
                rows = rows.where(word.startswith(w))
            else:
                rows = rows.where((F.col("bucket") == _bucket(F.lit(w))) & (word == w))
            if j > 0:
                rows = rows.where(F.col("before").endswith(seps[j - 1]) if j == 1 and words[0] == "" else F.col("before") == seps[j - 1])
            if j < last:
                rows = rows.where(F.col("after").startswith(seps[j]) if j == last - 1 and words[last] == "" else F.col("after") == seps[j])
            parts.append(rows.select(*KEY, (F.col("place") - j).alias("start"), F.lit(j).alias("j")))
        if len(parts) == 1:
            return parts[0].select(*KEY).distinct()
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        # A word stands once at a place, so a start with all words has as many rows.
        return found.groupBy(*KEY, "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(parts)).select(*KEY).distinct()

    def content_scores(self, query: str) -> DataFrame:
        """(project, doc_ord, content_score) of the documents that score; no text is read."""
        q = query.lower().strip()
        sha = hashlib.sha256(q.encode()).hexdigest()
        equal = self.table("whole").where(F.col("sha") == sha).select(*KEY, F.lit(3).alias("level"), F.lit(SCORE_EQUAL).alias("s"))
        contains = self.containing(q).select(*KEY, F.lit(2).alias("level"), F.lit(SCORE_CONTAINS).alias("s"))
        tokens = self.token_scores(query).select(*KEY, F.lit(1).alias("level"), F.col("tok_score").alias("s"))
        rows = equal.unionByName(contains).unionByName(tokens)
        return rows.groupBy(*KEY).agg(F.max_by("s", "level").alias("content_score"))
