"""Suffix-array dedup, built blockwise over a difference cover.

A suffix counts by its first ``LENGTH`` bytes (50). Its bytes go if a document with a smaller id has a suffix
that starts with the same 50. For that, equal suffixes have to meet; their order otherwise doesn't matter, so
strings get names (96-bit hashes) in place of lexicographic ranks, and a bucket holds the suffixes of a range of
names: ranges of leading bytes would put the suffixes of a frequent passage, or of a frequent letter, into one
bucket. Two texts can't differ and share a name but by chance: with w suffixes in all, w * w / 2**97 wrong pairs
are expected, 0.06 for the 10**14 suffixes of 100 TB.

Difference cover: positions p with p mod 31 in ``COVER``. Any two positions i and j have a common shift d < 31
at which i + d and j + d both lie in the cover; so two equal suffixes of 50 bytes agree on the 20 bytes that
start at some pair of cover positions. The names of these samples are precomputed: a suffix without a shared
sample in its first 31 positions is unique and never enters a bucket. That settles most of a corpus for a
fifth of its positions and four bytes each (a sample's name only picks candidates).

Blockwise: documents are dealt to blocks by hash of their id, rows without one by hash of their text; a block is a few MB of text held in one
task's arrays. In each block names are made distinct first, so that a passage with any number of
copies sends one row per block. Suffix buckets are dealt to tasks, and a task sorts one bucket at a time. They are
worked off in ``ROUNDS`` groups, each of which frees its shuffle before the next one starts, so disk and
memory are bounded by a group, not by the suffixes. Answers go back as one bit for each name that a
block sent, in the order in which it sent them; blocks are deterministic, so the bits find their places.

Texts equal to a text of a smaller id are settled by their SHA-256 beforehand.

Defined results: null counts as empty; texts under 50 bytes lose nothing; rows that repeat a doc_id with equal
text get the same result; of rows that repeat an id with different texts none is smaller than the other; null ids
are equal to each other and larger than any other; empty input gives no rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

LENGTH = 50
#: A difference cover: every residue is a difference of two of these.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
SAMPLE = LENGTH - PERIOD + 1
ROUNDS = 2
#: Bytes of text that a block has on average at least, and at most.
LEAST_BLOCK, MOST_BLOCK = 2 << 20, 64 << 20
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_MARKER, _SAMPLE_BITS, _SUFFIX_BITS, _TEXT = range(4)
_ROW = "block int, kind int, id long, part int, data binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def names(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of the strings of ``length`` bytes that start at ``at``; ``data`` ends in 8 spare bytes."""
    eight = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    out = np.zeros(len(at), dtype=np.uint64)
    for offset in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        out = _mixed(_mixed(out ^ eight[at + offset]))
    return out


def names_of_suffixes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96-bit names of the suffixes that start at ``at``: 64 bits, which deal them to buckets, and 32 more."""
    eight = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    more = np.zeros(len(at), dtype=np.uint64)
    for offset in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        more = (more ^ eight[at + offset]) * np.uint64(0xD6E8FEB86659FD93)
        more ^= more >> np.uint64(32)
    return names(data, at, LENGTH), (more >> np.uint64(32)).astype(np.uint32)


def in_order(name: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the names, and where in it a new one begins."""
    order = np.argsort(name)
    n = name[order]
    new = np.append(True, n[1:] != n[:-1])
    if more is not None:
        m = more[order]
        differs = np.append(False, m[1:] != m[:-1])
        if (differs & ~new).any():  # names that agree in 64 bits only
            order = np.lexsort((more, name))
            n, m = name[order], more[order]
            new, differs = np.append(True, n[1:] != n[:-1]), np.append(False, m[1:] != m[:-1])
        new |= differs
    return order, np.flatnonzero(new)


def part_of(name: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of a name; buckets are ranges of names, so names in order are buckets in order."""
    return (name >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


@dataclass
class Groups:
    """The distinct names in order with their buckets, the first and last document of each, and each place's name."""

    part: np.ndarray
    name: np.ndarray
    more: np.ndarray | None
    first: np.ndarray
    last: np.ndarray
    of: np.ndarray


def runs(part: np.ndarray) -> list[tuple[int, int]]:
    """From and to of each stretch of equal values."""
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else []
    return list(zip(cuts, cuts[1:], strict=False))


def grouped(name: np.ndarray, doc: np.ndarray, parts: int, more: np.ndarray | None = None) -> Groups:
    if not len(name):
        return Groups(name, name, more, doc, doc, np.zeros(0, np.int64))
    order, new = in_order(name, more)
    d = doc[order]
    of = np.empty(len(name), dtype=np.int64)
    of[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(name))))
    own = name[order[new]]
    return Groups(part_of(own, parts), own, None if more is None else more[order[new]], np.minimum.reduceat(d, new), np.maximum.reduceat(d, new), of)


def packed_ids(ids: np.ndarray) -> bytes:
    """Document ids as a table of the different ones and codes of 16 or 32 bits."""
    table, code = np.unique(ids, return_inverse=True)
    return np.uint32(len(table)).tobytes() + table.astype("<i8").tobytes() + code.astype("<u2" if len(table) <= 1 << 16 else "<u4").tobytes()


def unpacked_ids(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    return np.frombuffer(data, "<i8", n, 4)[np.frombuffer(data, "<u2" if n <= 1 << 16 else "<u4", -1, 4 + 8 * n)]


class Block:
    """The texts of a block, joined, and what the rounds before have said about them."""

    def __init__(self, rows: list[tuple], parts: int):
        gone = {(r[2], bytes(r[4])) for r in rows if r[1] == _MARKER}
        ids_gone = {k for k, _ in gone}
        self.bits: dict[int, dict[int, bytes]] = {_SAMPLE_BITS: {}, _SUFFIX_BITS: {}}
        texts = {}
        for _, kind, id_, part, data in rows:
            if kind == _TEXT:
                if id_ not in ids_gone or (id_, hashlib.sha256(data).digest()) not in gone:
                    texts[id_, bytes(data)] = None  # equal rows once
            elif kind != _MARKER:
                self.bits[kind][part] = data
        keys = sorted(texts)
        self.parts = parts
        self.ids = np.array([k for k, _ in keys], dtype=np.int64)
        self.texts = [t for _, t in keys]
        self.size = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(self.texts) + bytes(8), dtype=np.uint8)

    def said(self, kind: int, groups: Groups) -> np.ndarray:
        """The bit of each group; groups without an answer have 0."""
        out = np.zeros(len(groups.part), dtype=bool)
        for a, b in runs(groups.part):
            if (bits := self.bits[kind].get(int(groups.part[a]))) is not None:
                out[a:b] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a)
        return out

    def samples(self) -> tuple[np.ndarray, Groups]:
        """The places of the cover in texts that hold a suffix, as far as a sample fits, and their names."""
        most = int(self.size.max(initial=0))
        cover, none = np.resize(_IN_COVER, most), np.zeros(max(most, SAMPLE), dtype=bool)
        count = np.append(0, np.cumsum(cover))
        fits = np.where(self.size >= LENGTH, self.size - SAMPLE + 1, 0)
        masks = [m for f, n in zip(fits.tolist(), self.size.tolist(), strict=True) for m in (cover[:f], none[:n - f])]
        at = np.flatnonzero(np.concatenate(masks)) if masks else np.zeros(0, np.int64)
        return at, grouped(names(self.data, at, SAMPLE), np.repeat(np.arange(len(fits)), count[fits]), self.parts)

    def suffixes(self, rounds: int = 1, turn: int = 0) -> tuple[np.ndarray, np.ndarray, Groups]:
        """Starts and documents of the suffixes that have a shared sample, and their names; of every ``rounds``-th bucket."""
        at, groups = self.samples()
        shared = (self.said(_SAMPLE_BITS, groups) | (groups.first != groups.last))[groups.of]
        at = at[shared]
        end = self.begin + self.size
        doc = np.searchsorted(end, at, side="right")
        lo, hi = np.maximum(at - PERIOD + 1, self.begin[doc]), np.minimum(at, end[doc] - LENGTH)
        some = lo <= hi
        n = len(self.data) + 1
        start = np.flatnonzero(np.cumsum(np.bincount(lo[some], minlength=n) - np.bincount(hi[some] + 1, minlength=n)) > 0)
        name, more = names_of_suffixes(self.data, start)
        if rounds > 1:
            now = part_of(name, self.parts) % np.uint64(rounds) == turn
            start, name, more = start[now], name[now], more[now]
        doc = np.searchsorted(end, start, side="right")
        return start, doc, grouped(name, doc, self.parts, more)


def blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[int, Block]]:
    """The blocks of a partition that is sorted by block, one at a time."""
    held: list[tuple] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("block", "kind", "id", "part", "data")]
        for row in zip(*columns, strict=True):
            if held and held[-1][0] != row[0]:
                yield held[-1][0], Block(held, parts)
                held = []
            held.append(row)
    if held:
        yield held[-1][0], Block(held, parts)


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of one bucket at a time, of a partition sorted by bucket."""
    held: list[tuple] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "block", "names", "ids")]
        for row in zip(*columns, strict=True):
            if held and held[-1][0] != row[0]:
                yield held[-1][0], held
                held = []
            held.append(row)
    if held:
        yield held[-1][0], held


def _sent(block: int, groups: Groups, kind: str, ids: np.ndarray | None) -> pa.RecordBatch:
    cuts = runs(groups.part)
    # Of samples the lower half of the name is sent, of suffixes all of it.
    data = [groups.name[a:b].astype(kind).tobytes() + (b"" if ids is None else groups.more[a:b].astype("<u4").tobytes()) for a, b in cuts]
    own = [None if ids is None else packed_ids(ids[a:b]) for a, b in cuts]
    return pa.RecordBatch.from_arrays([pa.array([int(groups.part[a]) for a, _ in cuts], pa.int32()), pa.array([block] * len(cuts), pa.int32()), pa.array(data, pa.binary()), pa.array(own, pa.binary())],
                                      names=["part", "block", "names", "ids"])


def _answered(part: int, rows: list[tuple], kind: int, bits: np.ndarray, sizes: list[int]) -> pa.RecordBatch:
    ends = np.cumsum(sizes)
    data = [np.packbits(bits[e - n:e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([None] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(data, pa.binary())],
                                      names=["block", "kind", "id", "part", "data"])


def send_samples(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in blocks(batches, parts):
            yield _sent(number, block.samples()[1], "<u4", None)
    return run


def answer_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bit: another block has the name as well."""
    for part, rows in buckets(batches):
        sizes = [len(r[2]) // 4 for r in rows]
        name = np.frombuffer(b"".join(r[2] for r in rows), dtype="<u4")
        order = np.argsort(name)
        same = np.diff(name[order]) == 0
        bits = np.zeros(len(name), dtype=bool)
        bits[order] = np.append(same, False) | np.append(False, same) if len(name) else bits
        yield _answered(part, rows, _SAMPLE_BITS, bits, sizes)


def send_suffixes(parts: int, rounds: int, turn: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in blocks(batches, parts):
            groups = block.suffixes(rounds, turn)[2]
            yield _sent(number, groups, "<u8", block.ids[groups.first])
    return run


def answer_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bit: another block has the suffix in a document with a smaller id."""
    for part, rows in buckets(batches):
        sizes = [len(r[2]) // 12 for r in rows]
        name = np.frombuffer(b"".join(r[2][:8 * n] for r, n in zip(rows, sizes, strict=True)), dtype="<u8")
        more = np.frombuffer(b"".join(r[2][8 * n:] for r, n in zip(rows, sizes, strict=True)), dtype="<u4")
        id_ = np.concatenate([unpacked_ids(r[3]) for r in rows])
        order, new = in_order(name, more)
        d = id_[order]
        bits = np.empty(len(name), dtype=bool)
        bits[order] = np.repeat(np.minimum.reduceat(d, new), np.diff(np.append(new, len(d)))) < d
        yield _answered(part, rows, _SUFFIX_BITS, bits, sizes)


def cut(parts: int) -> Callable:
    """What is left of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in blocks(batches, parts):
            start, doc, groups = block.suffixes()
            goes = (block.said(_SUFFIX_BITS, groups)[groups.of] | (block.ids[doc] > block.ids[groups.first[groups.of]])) if len(start) else np.zeros(0, bool)
            steps = np.zeros(len(block.data) + 1, dtype=np.int32)
            steps[start[goes]] += 1  # starts are distinct
            steps[start[goes] + LENGTH] -= 1
            gone = np.cumsum(steps)[: len(block.data)] > 0
            out = {"id": [], "sha": [], "n_removed": [], "n_spans": [], "kept": [], "kept_sha256": []}
            for k, (a, n) in enumerate(zip(block.begin.tolist(), block.size.tolist(), strict=True)):
                off = gone[a:a + n]
                kept = block.data[a:a + n][~off].tobytes()
                row = (int(block.ids[k]), hashlib.sha256(block.texts[k]).hexdigest(), int(off.sum()), int(np.count_nonzero(np.diff(off, prepend=False) & off)), kept, hashlib.sha256(kept).hexdigest())
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))
    return run


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]."""
    id_ = F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))
    raw = text_or_empty(text).cast("binary")
    deal = F.when(F.col(doc_id).isNull(), F.xxhash64(raw)).otherwise(F.xxhash64(id_)).alias("deal")
    thin = written(docs.select(F.col(doc_id).alias("doc_id"), id_.alias("id"), deal, F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha")))
    first = written(thin.groupBy("sha").agg(F.min("id").alias("first")))
    thin = written(thin.join(first, "sha"))
    total = thin.agg(F.sum("n_bytes")).first()[0] or 0
    # Blocks and buckets grow with the root of the input, up to 64 MB each, so that rows between them stay few.
    parts = max(1, math.ceil(total / min(MOST_BLOCK, max(LEAST_BLOCK, 64 * math.isqrt(total)))))
    block = F.pmod("deal", F.lit(parts)).cast("int").alias("block")
    nothing = F.lit(None).cast("int").alias("part")
    texts = docs.select(id_.alias("id"), deal, raw.alias("data")).select(block, F.lit(_TEXT).alias("kind"), "id", nothing, "data")
    markers = thin.where("id > first").select(block, F.lit(_MARKER).alias("kind"), "id", nothing, F.unhex("sha").alias("data"))

    def in_blocks(*answers: DataFrame) -> DataFrame:
        rows = texts.unionByName(markers)
        for a in answers:
            rows = rows.unionByName(a)
        return rows.repartition("block").sortWithinPartitions("block", "kind", "id")

    def in_buckets(sent: DataFrame) -> DataFrame:
        return sent.repartition("part").sortWithinPartitions("part", "block")

    to = "part int, block int, names binary, ids binary"
    shared = written(in_buckets(in_blocks().mapInArrow(send_samples(parts), to)).mapInArrow(answer_samples, _ROW))
    repeated = [written(in_buckets(in_blocks(shared).mapInArrow(send_suffixes(parts, rounds, turn), to)).mapInArrow(answer_suffixes, _ROW)) for turn in range(rounds)]
    done = in_blocks(shared, *repeated).mapInArrow(cut(parts), "id long, sha string, n_removed long, n_spans long, kept binary, kept_sha256 string")
    done = done if with_text else done.drop("kept")
    done = written(done)
    stay = thin.where("id = first").join(done, ["id", "sha"])
    whole = F.col("n_bytes") >= LENGTH  # an equal text of a smaller id covers every byte
    copies = thin.where("id > first")
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if with_text:  # a short copy keeps what its first has whole
        copies = copies.join(done.select(F.col("sha"), F.when(F.length("kept") < LENGTH, F.col("kept")).alias("short")), "sha")
        copies = copies.withColumn("kept", F.when(whole, F.lit(b"")).otherwise(F.col("short")))
        columns.append("kept")
    copies = copies.withColumns({
        "n_removed": F.when(whole, F.col("n_bytes")).otherwise(0), "n_spans": whole.cast("long"),
        "kept_sha256": F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha"))})
    return stay.select(*columns).unionByName(copies.select(*columns))
