"""Token-id files: canonical length-limited Huffman codes from global counts.

Layout of a written folder: ``codebook`` holds (id, length), from which the canonical codes follow;
``blocks`` holds segments of about ``SEGMENT`` ids in ascending document order: the documents and their
numbers of ids, one bit stream, and the bit offset of every block of 1024 ids, so a reader can start at any
block. Segments are rows of Parquet files (uncompressed; the payload is coded already): Spark's committer makes retries and lost
executors harmless, and any file system that Spark reaches will do.

Steps: tokenize once into a written table of 16-bit ids; count ids per task and sum (one number per id of the
vocabulary reaches the driver); deal documents by ranges of doc_id, sort, encode and write. A document's place
among all ids is its place in its range plus the sizes of the ranges before, one row per range.

Defined results: a null or empty text has only its end id; null doc_ids come first; rows that repeat a doc_id
stay separate, next to each other; empty input writes an empty folder and reads no rows; other columns are
not carried.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import huffman
from .common import save, shared_folder, written
from .tokens import TOKENIZER, encoded

END_ID = 2
SEGMENT = 1 << 20
#: Ids in a range of documents at most, on average; a range is a task and a file.
RANGE = 1 << 25
IDS = 1 << 16


def token_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): 16-bit little-endian ids with the end id."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, bounds in encoded(batches, doc_id, text, tokenizer, end_id):
            blobs = pa.Array.from_buffers(pa.large_binary(), len(doc_ids), [None, pa.py_buffer(2 * bounds.astype(np.int64)), pa.py_buffer(ids.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([doc_ids, blobs.cast(pa.binary())], names=["doc_id", "ids"])

    return docs.select(doc_id, text).mapInArrow(rows, f"doc_id {kind}, ids binary")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and the number of ids of each row."""
    blobs = column.cast(pa.large_binary())
    bounds = np.frombuffer(blobs.buffers()[1], dtype=np.int64)[blobs.offset:blobs.offset + len(blobs) + 1]
    data = np.frombuffer(blobs.buffers()[2] or b"", dtype="<u2")
    return data[bounds[0] // 2:bounds[-1] // 2], np.diff(bounds) // 2


def id_counts(table: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(IDS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(flat(batch.column(0))[0], minlength=IDS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["id", "n"])

    counts = np.zeros(IDS, dtype=np.int64)
    for r in table.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def write_files(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    table = written(token_table(docs, doc_id, text, tokenizer, end_id))
    counts = id_counts(table)
    lengths = huffman.code_lengths(counts)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    save(spark.createDataFrame(book, "id int, length int").coalesce(1), f"{path}/codebook")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, number, done = huffman.codes(lengths), TaskContext.get().partitionId(), 0, 0
        held, size = [], 0

        def segment() -> pa.RecordBatch:
            nonlocal number, done, held, size
            both = pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(1).cast(pa.large_binary()) for b in held])
            ids, n = flat(both[1])
            data, offsets = huffman.encode(ids, code, lengths)
            row = {"part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()), "start": pa.array([done], pa.int64()),
                   "n_ids": pa.array([len(ids)], pa.int64()), "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), both[0]),
                   "sizes": pa.array([n.tolist()], pa.list_(pa.int64())), "bit_offsets": pa.array([offsets.tolist()], pa.list_(pa.int64())), "bits": pa.array([data], pa.binary())}
            number, done, held, size = number + 1, done + len(ids), [], 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            ends = np.cumsum(flat(batch.column(1))[1])
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(ends // SEGMENT)) + 1, [batch.num_rows]])).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                held.append(batch.slice(a, b - a))
                size += int(ends[b - 1] - (ends[a - 1] if a else 0))
                if size >= SEGMENT:
                    yield segment()
        if held:
            yield segment()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(int(counts.sum()) / RANGE))
    # Rows that repeat an id go by their ids' checksum: equal ones may change places, others never do.
    order = [F.col("doc_id").asc_nulls_first(), F.crc32("ids")]
    dealt = table.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = f"part int, segment int, start long, n_ids long, doc_ids array<{kind}>, sizes array<long>, bit_offsets array<long>, bits binary"
    save(dealt.mapInArrow(segments, schema), f"{path}/blocks", "none")


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files."""
    lengths = np.zeros(IDS, dtype=np.uint8)
    for r in spark.read.parquet(f"{path}/codebook").collect():  # at most the vocabulary
        lengths[r["id"]] = r["length"]
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = huffman.decoding_table(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                sizes = np.asarray(row["sizes"].values, dtype=np.int64)
                ids = huffman.decode(row["bits"].as_py(), np.asarray(row["bit_offsets"].values), row["n_ids"].as_py(), table)
                data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes)
                blobs = [data[4 * a:4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                columns = {"part": pa.array(np.full(len(sizes), row["part"].as_py(), dtype=np.int32)), "doc_id": row["doc_ids"].values,
                           "at": pa.array(row["start"].as_py() + ends - sizes), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(list(map(zlib.crc32, blobs)), pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array([bytes(b) for b in blobs], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    decoded = blocks.select("part", "start", "n_ids", "doc_ids", "sizes", "bit_offsets", "bits").mapInArrow(
        documents, f"part int, doc_id {kind}, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    sizes = blocks.groupBy(F.col("part").alias("of")).agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("of", F.coalesce(before, F.lit(0)).alias("before"))  # one row per range
    joined = decoded.join(F.broadcast(sizes), F.col("part") == F.col("of"))
    return joined.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` in the format to the shared folder and return what the files hold."""
    path = shared_folder(docs.sparkSession)
    write_files(docs, path, **options)
    return read_files(docs.sparkSession, path)
