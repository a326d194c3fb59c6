"""Exact dedup by two passes over a Bloom filter.

Pass 1 sets ``HASHES`` bits per text and keeps the bits that two or more rows set: the filter of hashes
that may repeat. Equal bits are counted before the shuffle, so a text with any number of copies sends one
row per task. The filter is written to the shared folder. Pass 2 tests every row against that filter, which is broadcast. Rows with a bit that nobody
else set are unique and pass straight through; only the others shuffle, by the SHA-256 of their
normalised text, which alone decides. A false positive costs a shuffled row, never a wrong result.

The broadcast filter holds one row per 64-bit word in which some bit repeats: at most
``FILTER_BITS / 64`` rows, whatever the input. When the input outgrows the filter, more unique rows
shuffle, and results stay the same.

Defined results: a null text counts as empty; texts that differ in runs of ASCII white space only are
equal; rows that repeat a doc_id with an equal text are counted in group_size and share its verdict
(``keep_one`` leaves one of them); a null doc_id is never smaller than another, and stays only where a
group has no other; empty input gives no rows; other columns pass through unchanged.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, clear_of_helpers, text_or_empty, written

#: Bits of the filter: 2**26 bits are at most 1,048,576 broadcast rows of two longs.
FILTER_BITS = 1 << 26
HASHES = 2


def _sha(text: str) -> Column:
    same = F.regexp_replace(text_or_empty(text), SPACE, " ")
    # Never null, and said so: else the planner hashes each text again to test for nulls.
    return F.coalesce(F.sha2(same.cast("binary"), 256), F.lit(""))


def _with_bits(rows: DataFrame) -> DataFrame:
    share = FILTER_BITS // HASHES  # each hash function has a stretch of the filter to itself
    return rows.withColumns({f"__bit{k}": F.pmod(F.xxhash64("__sha", F.lit(k)), F.lit(share)) + F.lit(k * share) for k in range(HASHES)})


def repeated_bits(hashed: DataFrame) -> DataFrame:
    """Pass 1: (word, bits) of all bits that at least two rows set."""
    bits = hashed.select(F.explode(F.array(*[F.col(f"__bit{k}") for k in range(HASHES)])).alias("bit"))
    again = bits.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return again.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))


def exact_groups(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``rows``, which have their text's hash as __sha, with __keep_id, __group_size and __kept."""
    columns = [c for c in rows.columns if c != "__sha"]
    hashed = _with_bits(rows)
    repeated = written(repeated_bits(hashed))
    tested = hashed
    for k in range(HASHES):
        words = repeated.select(F.col("word").alias(f"__word{k}"), F.col("bits").alias(f"__bits{k}"))
        tested = tested.join(F.broadcast(words), F.shiftright(F.col(f"__bit{k}"), 6) == F.col(f"__word{k}"), "left")
    hit = [F.coalesce(F.expr(f"(shiftright(__bits{k}, cast(__bit{k} & 63 as int)) & 1) = 1"), F.lit(False)) for k in range(HASHES)]
    tested = tested.withColumn("__maybe", reduce(and_, hit))
    alone = tested.where(~F.col("__maybe")).select(
        *columns, F.col(doc_id).alias("__keep_id"), F.lit(1).cast("long").alias("__group_size"), F.lit(True).alias("__kept"), "__sha")
    maybe = tested.where("__maybe").select(*columns, "__sha")
    groups = maybe.groupBy("__sha").agg(F.min(doc_id).alias("__keep_id"), F.count(F.lit(1)).alias("__group_size"))
    # Joined on one more form of the key, so that Spark deals both sides anew and can split a hot group's rows.
    groups = groups.select(F.col("__sha").alias("__of"), F.xxhash64("__sha").alias("__deal"), "__keep_id", "__group_size")
    copies = maybe.join(groups, (F.xxhash64("__sha") == F.col("__deal")) & (F.col("__sha") == F.col("__of"))).select(
        *columns, "__keep_id", "__group_size", F.col(doc_id).eqNullSafe(F.col("__keep_id")).alias("__kept"), "__sha")
    return alone.unionByName(copies)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    thin = written(docs.select(doc_id, _sha(text).alias("__sha")))  # a text is hashed once
    found = exact_groups(thin, doc_id)
    return found.select(F.col(doc_id).alias("doc_id"), F.col("__keep_id").alias("keep_id"), F.col("__group_size").alias("group_size"),
                        F.col("__kept").alias("kept"), F.col("__sha").alias("text_sha256"))


@clear_of_helpers
def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``; of rows that repeat id and text, one."""
    stay = exact_groups(docs.withColumn("__sha", _sha(text)), doc_id).where("__kept")
    single = stay.where("__group_size = 1").select(*docs.columns)
    return single.unionByName(stay.where("__group_size > 1").dropDuplicates(["__sha"]).select(*docs.columns))
