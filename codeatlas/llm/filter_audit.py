"""Filter interaction audit: what each filter removes in every order, and its Shapley value by exact least squares.

Each document gets a mask with one bit per filter that it fails; Spark adds documents up per part and mask, so a
part is at most 32 rows whatever it holds. From those, the documents that a coalition of filters removes are
tabulated for all 32 coalitions. A step's counts in any order are differences of two coalitions: those with and
without its filter. A filter's Shapley value is the solution of the least-squares problem over all coalitions,
weighted by the Shapley kernel, under the constraint that the values add up to what all filters remove
(efficiency); its normal equations are solved in rationals, so that the sums over all orders come out as integers.

A text's copies are found by its SHA-256: the smallest id per hash is taken before any row moves, and the join
back is one that Spark can split where a third of all rows share a text. Only ids, hashes, parts and masks shuffle.

Defined results: a null or empty text has no words and fails the word count alone (and is identical to other such
texts); a null source is the part of the empty string; a null id is larger than any other, so null ids are not
copies of each other; rows that repeat an id count each, and take an id's labels if any of its label rows has
them; an empty table has no parts and gives no rows; other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, words, written

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
_N = len(FILTERS)
_ALL = (1 << _N) - 1
_ROW = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, "
        "shapley long, filter string")


def own_failures(text: Column) -> Column:
    """Bits of the filters that look at the document alone, A to D."""
    def of(w: Column) -> Column:
        n, distinct = F.size(w), F.size(F.array_distinct(w))
        capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
        fails = [n < MIN_WORDS, F.lit(100) * distinct < F.lit(MIN_DISTINCT) * n, F.lit(100) * capitals > F.lit(MAX_CAPITALS) * F.length(text), text.rlike(SYMBOLS)]
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    # An array of one, so that the words are made once.
    return F.transform(F.array(words(text)), of)[0]


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A written table of id, part, sha, mask per document."""
    body = text_or_empty(text)
    thin = written(docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"),
                               F.sha2(body.cast("binary"), 256).alias("sha"), own_failures(body).cast("int").alias("mask")))
    # Of groups with one row nothing is to be joined.
    first = thin.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    first = first.select(F.col("sha").alias("of"), F.xxhash64("sha").alias("deal"), "first")
    joined = thin.join(first, (F.xxhash64("sha") == F.col("deal")) & (F.col("sha") == F.col("of")), "left")
    copy = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    return joined.select("id", "part", F.when(copy, F.col("mask") + (1 << 4)).otherwise(F.col("mask")).alias("mask"))


def inverse(matrix: list[list[Fraction]]) -> list[list[Fraction]]:
    n = len(matrix)
    rows = [[*r, *(Fraction(int(i == j)) for j in range(n))] for i, r in enumerate(matrix)]
    for c in range(n):
        pivot = next(r for r in range(c, n) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c], strict=True)]
    return [r[n:] for r in rows]


class Kernel:
    """The weighted least-squares problem over the coalitions of ``n`` players."""

    def __init__(self, n: int):
        self.n, self.proper = n, range(1, (1 << n) - 1)
        self.weight = {s: Fraction(n - 1, math.comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in self.proper}
        has = lambda s, i: s >> i & 1
        normal = [[sum((self.weight[s] for s in self.proper if has(s, i) and has(s, j)), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
        self.inverse = inverse([*normal, [Fraction(1)] * n + [Fraction(0)]])

    def solve(self, value: list[int]) -> list[Fraction]:
        """The players' values; ``value`` has one entry per coalition, the empty one first."""
        right = [sum((self.weight[s] * (value[s] - value[0]) for s in self.proper if s >> i & 1), Fraction(0)) for i in range(self.n)]
        right.append(Fraction(value[-1] - value[0]))
        return [sum((a * b for a, b in zip(row, right, strict=True)), Fraction(0)) for row in self.inverse[:self.n]]


def _removals(masks: list[tuple[int, int]]) -> list[int]:
    """Documents that each coalition removes."""
    return [sum(n for mask, n in masks if mask & s) for s in range(_ALL + 1)]


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kernel, schema = Kernel(_N), None
    orders = ["".join(p) for p in permutations(FILTERS)]
    for batch in batches:
        for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist(), strict=True):
            gone, good, toxic = (_removals([(m["mask"], m[c]) for m in masks]) for c in ("n", "good", "toxic"))
            whole = sum(m["n"] for m in masks)
            per_order = math.factorial(_N)
            shapley = [x * per_order for x in kernel.solve(gone)]
            if any(x.denominator != 1 for x in shapley):
                raise ArithmeticError(f"part {part!r}: sums over orders are not integers")
            rows = []
            for order in orders:
                before = 0
                for step, name in enumerate(order, 1):
                    f = FILTERS.index(name)
                    after = before | 1 << f
                    removed = gone[after] - gone[before]
                    rows.append((part, order, step, whole - gone[after], removed, gone[1 << f] - removed, gone[_ALL] - gone[_ALL & ~(1 << f)],
                                 good[after] - good[before], toxic[after] - toxic[before], int(shapley[f]), name))
                    before = after
            names = [c.split()[0] for c in _ROW.split(", ")]
            schema = schema or pa.schema([(n, pa.string() if n in ("part", "filter_order", "filter") else pa.int32() if n == "step" else pa.int64()) for n in names])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, filter."""
    marked = labels.groupBy(F.col("doc_id").alias("of_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = marked.where("of_id is not null and (good = 1 or toxic = 1)")
    rows = failures(docs, doc_id, text, source).join(marked, F.col("id") == F.col("of_id"), "left")
    count = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")]
    masks = rows.groupBy("part", "mask").agg(*count)
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 32 each
    return parts.mapInArrow(_audits, _ROW)
