"""Quality classifier by Bradley-Terry pairwise ranking.

Each labelled pair (good, bad) says that one text beats another; the probability of that is the logistic
function of the difference of their scores, a score being linear in text statistics. Weights minimise the
logistic loss on feature differences. A quantile of the training scores becomes the threshold, and the logistic
function of a score's distance from it the result, so that 0.5 is the threshold.

Every labelled training row takes part in the fit, and no task holds more than a block of them: rows are dealt by
hash to blocks of about ``PER_BLOCK`` rows of each class, a block's pairs give its weights, and the model has the mean
of the blocks' weights. The smaller class is dealt to fewer blocks, each of which meets several of the larger one, so
every row of the larger class has opponents. Means and spreads of the features, and the quantile of the scores, are
those of all training rows. Features are made once per text, in Arrow batches, and stored for the fit and the scores;
the driver holds the model and counts.

Features see the text alone: shares of ASCII characters and others, word and line statistics, how well
neighbouring words repeat, and how far the text compresses.

Defined results: null or empty texts have zero features and get a score like any other; labels that are null
count for nothing, a document with several labels has their rounded mean; without both classes among the
training rows every score is the share of label 1 (0.5 without any label); repeated rows are scored each; empty
input gives no rows; other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.plans.partitioning import running_total
from codeatlas.plans.stored import stored

#: Labelled rows of each class in a block, on average at most.
PER_BLOCK = 6000
PAIRS_EACH = 8
ROUNDS = 300
RIDGE = 1e-3
N_FEATURES = 129 + 10


def held_out(doc_id: Column) -> Column:
    """Rows that no fit sees: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(text: str | None) -> np.ndarray:
    out = np.zeros(N_FEATURES, dtype=np.float32)
    raw = (text or "").encode()
    if not raw:
        return out
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    out[:128], out[128] = seen[:128] / len(raw), seen[128:].sum() / len(raw)
    words = raw.split()
    if words:
        sizes = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
        different = len(set(words))
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out[129:] = (sizes.mean() / 10, sizes.std() / 10, different / len(words), np.log1p(len(words)) / 10, same / len(words),
                     1 - len(set(lines)) / len(lines), len(lines) / len(words), (sizes == 1).mean(),
                     min(1.0, len(zlib.compress(raw, 1)) / len(raw)), np.log1p(different) / np.log1p(len(words)))
    return out


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the documents that a fit may see."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, ``carried``, y) of at most ``per_class`` training rows of each class."""
    known = known_labels(labels, label)
    chosen = None
    for y in (0, 1):  # sorted and cut in every task, so no task holds more than per_class rows
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * per_class rows of two numbers.
    return docs.select("doc_id", "text", *carried).join(F.broadcast(chosen.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id")).select("doc_id", "text", *carried, "y")


def fit_bradley_terry(good: np.ndarray, bad: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights whose score differences explain that every ``good`` row beats the ``bad`` rows it is paired with."""
    rng = np.random.default_rng(seed)
    n = max(len(good), len(bad)) * PAIRS_EACH
    a, b = rng.permutation(n) % len(good), rng.permutation(n) % len(bad)
    w, momentum = np.zeros(good.shape[1]), np.zeros(good.shape[1])
    for step in range(ROUNDS):
        loss_slope = np.zeros(len(w))
        score_a, score_b = good @ w, bad @ w
        lost = 1 / (1 + np.exp(np.clip(score_a[a] - score_b[b], -30, 30)))
        loss_slope = np.bincount(b, lost, len(bad)) @ bad - np.bincount(a, lost, len(good)) @ good
        momentum = 0.9 * momentum - 0.3 * (loss_slope / n + RIDGE * w)
        w = w + momentum
    return w


def as_matrix(x: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), dtype=np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def in_blocks(rows: DataFrame, sizes: dict[int, int], per_block: int) -> DataFrame:
    """``rows`` (doc_id, x, y) with a ``block``: each row of the larger class in one, those of the smaller in one or more."""
    larger = max(sizes, key=lambda y: (sizes[y], y))
    n_blocks, n_parts = -(-sizes[larger] // per_block), -(-sizes[1 - larger] // per_block)
    # Repeated rows are told apart by a number, so that they spread like others.
    copies = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "y").orderBy("x")))
    dealt = F.xxhash64("doc_id", "copy")
    blocks = F.when(F.col("y") == larger, F.array(F.pmod(dealt, F.lit(n_blocks)))).otherwise(
        F.sequence(F.pmod(dealt, F.lit(n_parts)), F.lit(n_blocks - 1).cast("long"), F.lit(n_parts).cast("long")))
    return copies.select("doc_id", "x", "y", F.explode(blocks).alias("block"))


def linear(x: np.ndarray, model: dict) -> np.ndarray:
    return (x - model["mean"]) / model["spread"] @ model["w"]


def fit(rows: DataFrame, per_block: int = PER_BLOCK) -> dict:
    """Model from all (doc_id, x, y) rows; ``rows`` is read several times."""
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return {"constant": float(next(iter(sizes), 0.5))}

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = as_matrix(batch.column("x"))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(N_FEATURES, dtype=np.int32), len(x))), pa.array(x.ravel())], names=["k", "v"])

    # Rounded, as sums of doubles depend on the order in which tasks end.
    stats = rows.select("x").mapInArrow(values, "k int, v double").groupBy("k").agg(F.round(F.avg("v"), 12).alias("mean"), F.round(F.stddev_pop("v"), 12).alias("spread"))
    stats = stats.orderBy("k").collect()  # one row per feature
    mean, spread = np.array([r["mean"] for r in stats]), np.array([r["spread"] for r in stats]) + 1e-3

    def fit_block(block: pa.Table) -> pa.Table:
        block = block.sort_by([("y", "ascending"), ("doc_id", "ascending"), ("x", "ascending")])
        y, z = block.column("y").to_numpy(), (as_matrix(block.column("x")) - mean) / spread
        good, bad = z[y == 1], z[y == 0]
        w = [fit_bradley_terry(good, bad)] if len(good) and len(bad) else []
        return pa.table({"n": pa.array([max(len(good), len(bad))] * len(w), pa.int64()), "w": pa.array([v.tolist() for v in w], pa.list_(pa.float64()))})

    fits = in_blocks(rows, sizes, per_block).groupBy("block").applyInArrow(fit_block, "n long, w array<double>")
    weights = fits.select("n", F.posexplode("w").alias("k", "v")).groupBy("k").agg(F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 12).alias("w"))
    model = {"mean": mean, "spread": spread, "w": np.array([r["w"] for r in weights.orderBy("k").collect()])}

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(linear(as_matrix(batch.column("x")), model)), batch.column("y")], names=["score", "y"])

    # The quantile of the training scores with the best balanced accuracy. Rows before one are counted in one sum, the bad ones in its upper half.
    bad = F.when(F.col("y") == 0, F.lit(1 << 32)).otherwise(F.lit(1)).cast("long")
    ranked = running_total(rows.select("x", "y").mapInArrow(scores, "score double, y int").withColumns({"all": F.lit(0), "one": bad}), ["all"], ["score", "y"], "one", "before")
    upto = F.col("before") + F.col("one")
    n_bad, n_good = F.shiftright(upto, 32), upto.bitwiseAND(F.lit((1 << 32) - 1))
    ranked = stored(ranked.select("score", (n_bad + n_good).alias("place"), (n_bad / sizes[0] - n_good / sizes[1]).alias("gain")))
    best = ranked.where(F.col("place") < sum(sizes.values())).agg(F.max_by("place", F.struct("gain", -F.col("place"))).alias("k")).first()["k"]
    found = ranked.agg(F.avg(F.when(F.col("place").isin(best, best + 1), F.col("score"))).alias("threshold"), F.round(F.stddev_pop("score"), 12).alias("spread")).first()
    return model | {"threshold": found["threshold"], "unit": found["spread"] / 4 + 1e-9}


def with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.binary())], names=["doc_id", "x"])


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", per_block: int = PER_BLOCK) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = stored(docs.select("doc_id", "text").mapInArrow(with_features, f"doc_id {kind}, x binary"))
    model = fit(stored(seen.join(known_labels(labels, label).where(F.col("y").isin(0, 1)), "doc_id")), per_block)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if "constant" in model:
                p = np.full(batch.num_rows, model["constant"])
            else:
                s = linear(as_matrix(batch.column("x")), model)
                p = 1 / (1 + np.exp(np.clip(-(s - model["threshold"]) / model["unit"], -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    scored = seen.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
