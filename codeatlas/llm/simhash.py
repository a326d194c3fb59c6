"""SimHash near-dedup with BK-trees.

Fingerprints: a document's word shingles are hashed by XXH64; a bit is set where it is set in over half the
hashes. Only the different fingerprints go on, with their smallest doc_id.

Shards: two fingerprints that differ in at most r bits agree on two of r + 2 blocks of their bits, whichever
pair of blocks that is; so each fingerprint joins one shard per pair of blocks, the one of its bits there, and
every link lies within a shard. The shard is dealt, whole, to the task that holds all its queries: that is how
a shard's tree reaches the queries that can match it, instead of all trees being broadcast to all tasks, which
would have no size bound. A shard of more than ``SHARD`` fingerprints is split by one more block of the
remaining bits, r + 1 ways, again without losing a pair; as fingerprints are distinct, such a part can't hold
more than the bits left over allow.

BK-trees: in a shard the first fingerprint is the root, and a child hangs on the edge of its Hamming distance
to its parent. All trees of a task are built together, level by level, and searched together: a query with
distance d at a node follows only the edges d - r to d + r. Of the matches of a tree, one link per fingerprint
to its group's first leaves the task; ``components`` joins the groups.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; a text of fewer
words than a shingle is one shingle; rows that repeat a doc_id with equal text get the same answer; a group
whose doc_ids are all null has component_id null; empty input gives no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_of_helpers, text_or_empty, written
from .components import components

WORDS = 3
RADIUS = 2
SEED = 42
SHARD = 512
#: Rows after which a task searches the whole shards it has gathered.
GATHER = 50_000
QUERIES = 20_000


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each stretch of hashes that starts at ``first``: the bits set in over half of them."""
    out = np.empty(len(first), dtype=np.uint64)
    ends = np.append(first[1:], len(hashes))
    at = 0
    while at < len(first):  # so many hashes at a time that their bits fit a few MB
        to = max(at + 1, int(np.searchsorted(ends, first[at] + (1 << 17), side="right")))
        bits = np.unpackbits(hashes[first[at]:ends[to - 1]].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, first[at:to] - first[at], axis=0, dtype=np.int32)
        over = 2 * ones > (ends[at:to] - first[at:to])[:, None]
        out[at:to] = np.packbits(over, axis=1).view(">u8").reshape(-1)
        at = to
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, ``carried``): the fingerprint as a signed long."""
    kind = docs.schema[doc_id].dataType.simpleString()
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carried)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.uint64)
            hashes, rows, first, held = [], [], [], 0

            def flush() -> None:
                nonlocal hashes, rows, first, held
                if rows:
                    out[rows] = _majority(np.concatenate(hashes), np.array(first))
                hashes, rows, first, held = [], [], [], 0

            for k, value in enumerate(batch.column(text).cast(pa.large_binary())):
                parts = (value.as_py() or b"").lower().split()  # of bytes: A-Z, and ASCII white space
                if not parts:
                    continue
                line = memoryview(b" ".join(parts))
                ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
                starts = np.append(0, ends[:-1] + 1)
                n = max(1, len(parts) - words + 1)
                stops = ends[words - 1:] if len(parts) >= words else ends[-1:]
                cut = [line[a:b] for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)]
                rows.append(k)
                first.append(held)
                hashes.append(np.fromiter(map(xxh64_intdigest, cut, repeat(SEED)), dtype=np.uint64, count=n))
                held += n
                if held > 1 << 18:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(out.view(np.int64)), *map(batch.column, carried)], names=["doc_id", "fp", *carried])

    return docs.select(doc_id, text, *carried).mapInArrow(compute, f"doc_id {kind}, fp long{more}")


class Forest:
    """The BK-trees of the shards ``shard`` (equal numbers adjacent) over fingerprints ``fp``."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        self.fp = fp
        first = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1)) if len(shard) else np.zeros(0, int)
        self.root = np.repeat(first, np.diff(np.append(first, len(fp))))
        rows = np.flatnonzero(self.root != np.arange(len(fp)))
        at, edges, nodes = self.root[rows], [], []
        while len(rows):  # a level a turn: of the rows that reach an edge, the first becomes the child there
            edge = at * 65 + np.bitwise_count(fp[rows] ^ fp[at])
            edge, lead, which = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(edge)
            nodes.append(rows[lead])
            at = rows[lead][which]
            on = at != rows
            rows, at = rows[on], at[on]
        edges, nodes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edges, nodes))
        order = np.argsort(edges)
        self.edge, self.node = edges[order], nodes[order]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, node) within ``radius`` in the query's own shard."""
        q, at, found = queries, self.root[queries], []
        while len(q):
            d = np.bitwise_count(self.fp[q] ^ self.fp[at]).astype(np.int64)
            near = (d <= radius) & (q != at)
            found.append((q[near], at[near]))
            more = []
            for step in range(-radius, radius + 1):
                want = np.where((d + step >= 0) & (d + step <= 64), at * 65 + d + step, -1)
                place = np.searchsorted(self.edge, want)
                hit = np.flatnonzero((place < len(self.edge)) & (self.edge[np.minimum(place, len(self.edge) - 1)] == want)) if len(self.edge) else np.zeros(0, int)
                more.append((q[hit], self.node[place[hit]]))
            q, at = (np.concatenate(x) for x in zip(*more, strict=True))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def links(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """A link from each matched fingerprint to the first of its group in the shard."""
        label = np.arange(len(self.fp))
        for k in range(0, len(self.fp), QUERIES):
            a, b = self.search(np.arange(k, min(k + QUERIES, len(self.fp))), radius)
            while len(a):
                la, lb = label[a], label[b]
                off = la != lb
                a, b, la, lb = a[off], b[off], la[off], lb[off]
                np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
                while (label[label] != label).any():
                    label = label[label]
        own = np.flatnonzero(label != np.arange(len(label)))
        return own, label[own]


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of the radius + 2 blocks."""
    cuts = np.linspace(0, 64, radius + 3).astype(int).tolist()
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _joined(blocks: list[tuple[int, int]]) -> str:
    """SQL for the bits of the blocks, one above the other."""
    out = "0L"
    for low, n in blocks:
        out = f"(shiftleft({out}, {n}) | (shiftrightunsigned(fp, {low}) & {(1 << n) - 1}L))"
    return out


def sharded(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(shard, part, fp): every pair within ``radius`` shares a (shard, part)."""
    blocks = _blocks(radius)
    pairs = list(combinations(range(len(blocks)), 2))
    keys = [f"{k}L + {len(pairs)}L * {_joined([blocks[i], blocks[j]])}" for k, (i, j) in enumerate(pairs)]
    rests = [_joined([b for n, b in enumerate(blocks) if n not in pair]) for pair in pairs]
    all_ = distinct.select("fp", F.explode(F.expr("array(" + ", ".join(f"named_struct('shard', {k}, 'rest', {r})" for k, r in zip(keys, rests, strict=True)) + ")")).alias("s"))
    all_ = all_.select("fp", "s.shard", "s.rest")
    large = written(all_.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard).select(F.col("shard").alias("of")))
    flagged = all_.join(large, F.col("shard") == F.col("of"), "left")
    width = 64 - min(blocks[i][1] + blocks[j][1] for i, j in pairs)
    cuts = np.linspace(0, width, radius + 2).astype(int).tolist()
    parts = ", ".join(f"{k + 1}L + {radius + 2}L * (shiftrightunsigned(rest, {a}) & {(1 << (b - a)) - 1}L)" for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    return flagged.select("shard", F.explode(F.expr(f"if(of is null, array(0L), array({parts}))")).alias("part"), "fp")


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``radius`` of each other, each tree's groups as stars."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: np.ndarray) -> pa.RecordBatch:
            number = np.cumsum(np.any(np.diff(rows[:, :2], axis=0, prepend=rows[:1, :2]), axis=1))
            fp = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
            a, b = Forest(fp, number).links(radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["a", "b"])

        held, n = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("shard", "part", "fp")], axis=1))
            n += batch.num_rows
            if n >= GATHER:
                rows = np.concatenate(held)
                last = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last shard may go on in the next batch
                if cut:
                    yield done(rows[:cut])
                held, n = [rows[cut:]], len(rows) - cut
        if n:
            yield done(np.concatenate(held))

    dealt = sharded(distinct, radius, shard).repartition(F.col("shard"), F.col("part")).sortWithinPartitions("shard", "part", "fp")
    return dealt.mapInArrow(search, "a long, b long")


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id): the group of each fingerprint, named by one of them and by the smallest doc_id."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, radius)) if radius else None
    if roots is None:
        return distinct.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    linked = written(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = written(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    return written(linked.join(least, "root").select("fp", "root", "component_id"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id (the smallest doc_id reachable over links)."""
    prints = written(fingerprints(docs, doc_id, text, words))
    found = prints.join(_grouped(prints, radius), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@clear_of_helpers
def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each group, with the columns of ``docs``: that of the smallest doc_id, null ids last; of several
    rows with that id, the one whose text has the smallest SHA-256; of rows equal in both, any one."""
    sha = F.sha2(text_or_empty(text).cast("binary"), 256)
    prints = written(fingerprints(docs.withColumn("__sha", sha), doc_id, text, words, ("__sha",)))
    # Combined before the shuffles, so a group of any size, or a row that repeats, fills no task.
    rows = prints.groupBy("fp", "doc_id", "__sha").agg(F.count(F.lit(1)).alias("n")).join(_grouped(prints, radius).select("fp", "root"), "fp")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "__sha")
    first = written(rows.groupBy("root").agg(F.min_by(F.struct(F.col("doc_id").alias("__first"), F.col("__sha").alias("__its_sha"), F.col("n").alias("__n")), place).alias("x")).select("x.*"))
    same = F.col(doc_id).eqNullSafe(F.col("__first")) & (F.col("__sha") == F.col("__its_sha"))
    kept = lambda some: docs.withColumn("__sha", sha).join(first.where(some), same, "left_semi")
    single = kept(F.col("__n") == 1)
    if not first.where("__n > 1").isEmpty():
        single = single.unionByName(kept(F.col("__n") > 1).dropDuplicates([doc_id, "__sha"]))
    return single.select(*docs.columns)
