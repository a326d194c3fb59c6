"""Centroid clustering by scalar lookup tables.

Vectors are integers floor(scale * x). A block of up to ``BLOCK`` vectors is stored as codes: per dimension the
integer values that occur in the block, in order, and for each vector the place of its value among them. A round
tabulates, per block, the squared difference of every dimension's every occurring value to every centroid; a
vector's distances are then gathered from these tables and summed, without an arithmetic step per component.

Codes are written once to the shared folder; each round reads them in parallel and sends one row of sums per
task and cluster, which Spark adds up: what reaches the driver is one row per cluster and dimension. A block's
tables take the same memory whatever the values are, since they hold values of that block only.

All steps are exact in integers: ties go to the smaller number, a centroid is floor(sum / count) per component,
an empty one stays as it is. Seeds are the ``k`` kept vectors with the smallest sha256 of ``<seed>:<id>``.

Defined results: a vector is kept if it has exactly ``dims`` components, none null, NaN or infinite; others give no
row. A vector longer than 2**30 after scaling counts like one that is not finite, as no long holds its distances.
Rows that repeat an id are vectors of their own and take their seeds' order from their components; a null id is
hashed as the empty string. With fewer kept vectors than ``k`` there are fewer centroids; an empty table gives no
rows. Sums over vectors that exceed a long are null. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Vectors in a block; codes fit 16 bits.
BLOCK = 8192
_LONGEST = float(1 << 60)  # squared length: distances between such vectors and their means stay below 2**63
_MOST = (1 << 63) - 1


def integers(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are kept, and their components as integers, (rows, dims)."""
    flat = vectors.cast(pa.list_(pa.float64()))
    ends = flat.offsets.to_numpy()
    sizes = np.where(flat.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), -1)
    row = np.flatnonzero(sizes == dims)
    every = flat.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    x = every[ends[row][:, None] + np.arange(dims)] if len(row) else np.zeros((0, dims))
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(x * scale)
        fits = np.isfinite(x).all(axis=1) & ((whole * whole).sum(axis=1) <= _LONGEST)
    return row[fits], whole[fits].astype(np.int64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurring values of all dimensions one after another, the first place of each dimension, and the codes."""
    values, first, codes = [], [0], np.empty(vectors.shape, dtype=np.uint16)
    for d in range(vectors.shape[1]):
        own, code = np.unique(vectors[:, d], return_inverse=True)
        values.append(own)
        first.append(first[-1] + len(own))
        codes[:, d] = code
    return np.concatenate(values), np.array(first, dtype=np.int64), codes


def tables(values: np.ndarray, first: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(occurring value, centroid) -> squared difference."""
    dim = np.repeat(np.arange(len(first) - 1), np.diff(first))
    apart = values[:, None] - centroids[:, dim].T
    far = int(np.abs(apart).max(initial=0))
    small = far * far * centroids.shape[1] < 1 << 31
    return (apart * apart).astype(np.int32 if small else np.int64)


def distances(values: np.ndarray, first: np.ndarray, codes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(vector, centroid) -> squared distance, gathered from the tables and summed."""
    table = tables(values, first, centroids)
    total = np.zeros((len(codes), len(centroids)), dtype=table.dtype)
    for d in range(codes.shape[1]):
        total += table[first[d]:first[d + 1]].take(codes[:, d], axis=0)
    return total.astype(np.int64)


def _encoder(dims: int, scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0

        def block(ids: list[pa.Array], vectors: np.ndarray) -> pa.RecordBatch:
            values, first, codes = encode(vectors)
            one = pa.ListArray.from_arrays(pa.array([0, len(vectors)], pa.int32()), pa.concat_arrays(ids))
            data = [pa.array([x.tobytes()], pa.binary()) for x in (values, first, codes)]
            return pa.RecordBatch.from_arrays([one, *data], names=["ids", "values", "first", "codes"])

        for batch in batches:
            row, vectors = integers(batch.column("vector"), dims, scale)
            for at in range(0, len(row), BLOCK):
                part = row[at:at + BLOCK]
                if n + len(part) > BLOCK:
                    yield block(ids, np.concatenate(held))
                    ids, held, n = [], [], 0
                ids.append(batch.column("id").take(pa.array(part)))
                held.append(vectors[at:at + BLOCK])
                n += len(part)
        if n:
            yield block(ids, np.concatenate(held))
    return run


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple]:
    for batch in batches:
        for k in range(len(batch)):
            values, first, codes = (batch.column(c)[k].as_buffer() for c in ("values", "first", "codes"))
            yield batch.column("ids")[k].values, np.frombuffer(values, np.int64), np.frombuffer(first, np.int64), np.frombuffer(codes, np.uint16).reshape(-1, dims)


def _summer(centroids: np.ndarray) -> Callable:
    """One row of sums per task and cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        n, sums = np.zeros(k, dtype=np.int64), [[0] * dims for _ in range(k)]
        for _, values, first, codes in _blocks(batches, dims):
            cluster = distances(values, first, codes, centroids).argmin(axis=1)
            n += np.bincount(cluster, minlength=k)
            for d in range(dims):
                own = values[first[d]:first[d + 1]]
                # How often each value falls to each cluster; a value times its count fits a long.
                times = np.bincount(cluster * len(own) + codes[:, d], minlength=k * len(own)).reshape(k, len(own))
                for c, s in enumerate((times * own).sum(axis=1).tolist()):
                    sums[c][d] += s
        some = np.flatnonzero(n).tolist()
        text = pa.array([[str(s) for s in sums[c]] for c in some], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), text], names=["cluster", "n", "sums"])
    return run


def _assigner(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values, first, codes in _blocks(batches, centroids.shape[1]):
            apart = distances(values, first, codes, centroids)
            cluster = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(apart[np.arange(len(apart)), cluster], pa.int64())], names=["id", "cluster", "distance"])
    return run


def _seeder(k: int, dims: int, scale: int, seed: int) -> Callable:
    """The ``k`` kept vectors of a task with the smallest names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[tuple[str, list[int]]] = []
        for batch in batches:
            row, vectors = integers(batch.column("vector"), dims, scale)
            names = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i in batch.column("id").take(pa.array(row)).to_pylist()]
            bar = heapq.nsmallest(k, names)[-1] if names else ""
            least = heapq.nsmallest(k, least + [(name, vectors[j].tolist()) for j, name in enumerate(names) if name <= bar])
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in least], pa.string()), pa.array([v for _, v in least], pa.list_(pa.int64()))], names=["name", "vector"])
    return run


def seeds(thin: DataFrame, k: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The first centroids: kept vectors with the smallest hashes; only ``k`` rows reach the driver."""
    least = thin.mapInArrow(_seeder(k, dims, scale, seed), "name string, vector array<long>")
    return np.array([r.vector for r in least.orderBy("name", "vector").limit(k).collect()], dtype=np.int64)


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
            dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """A written table of id, cluster and distance per kept vector, and the final centroids."""
    thin = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("vector"))
    kind = thin.schema["id"].dataType.simpleString()
    centroids = seeds(thin, k, dims, scale, seed)
    if not len(centroids):
        return thin.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance long"), []
    blocks = written(thin.mapInArrow(_encoder(dims, scale), f"ids array<{kind}>, values binary, first binary, codes binary"))
    for _ in range(rounds):
        sums = blocks.mapInArrow(_summer(centroids), "cluster int, n long, sums array<string>")
        each = sums.select("cluster", "n", F.posexplode("sums").alias("dim", "s"))
        found = each.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        centroids = centroids.copy()
        for r in found:
            centroids[r.cluster, r.dim] = int(r.s) // r.n
    return written(blocks.mapInArrow(_assigner(centroids), f"id {kind}, cluster int, distance long")), centroids.tolist()


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, centroids = cluster(vectors, **options)
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(sums.values())
    long = lambda x: F.lit(x if x <= _MOST else None).cast("long")
    # One literal per cluster; there are k of them.
    inertia = F.array(long(0), *[long(sums.get(c, 0)) for c in range(len(centroids))])
    names = F.array(F.lit(""), *[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids])
    place = F.col("cluster") + 2
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", F.element_at(inertia, place).alias("cluster_inertia"),
                       long(whole).alias("inertia"), F.element_at(names, place).alias("centroid_sha256"))
