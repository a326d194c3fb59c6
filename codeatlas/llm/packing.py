"""Best-fit packing by minimum bin slack.

Documents are tokenized, closed with an end id and cut where longer than a sequence. Which lengths share a
sequence is decided on the counts of all pieces by length, at most ``capacity`` numbers however many pieces
there are: the longest length left opens a bin, a subset-sum over the lengths still available (one bit set
of reachable fills, multiplicities in powers of two) finds the fullest feasible rest, that combination is
removed, and at once as often as the counts allow, as nothing else would change until a length runs out.

Each piece then finds its place by its rank among the pieces of its length; ranks come from
``rank_in_group``, so a length that a third of all pieces share is numbered in many tasks. The plan that the
tasks look places up in has one row per (combination, length); a combination exhausts some length's count, so
the plan is bounded by the capacity as well, not by the input.

Defined results: a null or empty text is one piece that holds the end id only; a text that fits stays whole;
pieces of exactly ``capacity`` ids fill a sequence alone; rows that repeat a doc_id are packed each for
itself; empty input gives no rows; other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rank_in_group, written
from .tokens import TOKENIZER, encoded

CAPACITY = 2048
END_ID = 0


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths (with multiplicities) whose sum is the largest that fits ``room``."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (k * length)) & mask
            left, k = left - k, 2 * k
        if reach >> room:
            break
    fill, use = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> fill & 1:  # this step made the fill possible
            use[length] = use.get(length, 0) + k
            fill -= k * length
    return use


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, ranks, per sequence, first sequence, offset), sorted by length and rank."""
    left, taken, rows, sequence = {k: n for k, n in counts.items() if n}, {}, [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        use = fullest({k: n for k, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        use[longest] = use.get(longest, 0) + 1
        times, offset = min(left[k] // m for k, m in use.items()), 0
        for length in sorted(use, reverse=True):
            m = use[length]
            rows.append((length, taken.get(length, 0), times * m, m, sequence, offset))
            taken[length] = taken.get(length, 0) + times * m
            left[length] -= times * m
            if not left[length]:
                del left[length]
            offset += m * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): ids as little-endian unsigned 32-bit integers."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, bounds in encoded(batches, doc_id, text, tokenizer, end_id):
            data = memoryview(ids.astype("<u4").tobytes())
            n = -(-np.diff(bounds) // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = bounds[:-1][row] + piece * capacity
            stop = np.minimum(start + capacity, bounds[1:][row])
            blobs = [data[4 * a:4 * b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
            columns = {"doc_id": doc_ids.take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(piece * capacity, pa.int64()),
                       "length": pa.array(stop - start, pa.int64()), "ids_crc32": pa.array(list(map(zlib.crc32, blobs)), pa.int64())}
            if with_ids:
                columns["ids"] = pa.array([bytes(b) for b in blobs], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(doc_id, text).mapInArrow(cut, schema)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset."""
    cut = written(pieces(docs, doc_id, text, capacity, tokenizer, end_id, with_ids))
    # At most ``capacity`` rows reach the driver.
    slots = plan({r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, capacity)
    ranked = rank_in_group(cut, ["length"], "doc_id", ["piece"], "rank")
    names = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = slots[:, 0] << 48 | slots[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            _, first, _, per, sequence, offset = slots[np.searchsorted(keys, length << 48 | rank, side="right") - 1].T
            sequence, offset = sequence + (rank - first) // per, offset + (rank - first) % per * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
