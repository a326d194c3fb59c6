"""Benchmark decontamination with a generalised suffix automaton of the test items.

Texts are lower-cased (A-Z) and cut into words. The items' words make one automaton that accepts every run of
consecutive words of any item. A document streams through it: at each word the automaton knows the longest run
that ends there and occurs in an item. An item's limit is ``length`` words, or ``coverage`` percent of its words if
that is less; a run that reaches the limit of an item holding it is a match, and the words of all matches go.

Each state of the automaton knows the items whose limit falls into its range of lengths, and the nearest state on
its suffix links that knows one; so a word costs one look-up, and only matches cost more. Words outside the items
and pairs that no item holds can't be inside a match of two words: a vectorised pass drops them beforehand, and only
stretches as long as the least limit reach the automaton.

The automaton is built on executors and sent to all tasks. It has at most two states and three moves per word, and
holds at most ``SHARD_WORDS`` words. A larger set of items is dealt to shards by hash, half filled on average, and
the documents stream through one shard after another; long items are cut into overlapping pieces beforehand,
which keeps every run up to ``length`` words. Their matches are merged per document and text.

Defined results: null and empty texts have no words and no matches; an item without words is in no document; a null
item id is listed as the empty string; items that repeat an id count once, by the texts of all its rows; rows that
repeat a doc_id are documents of their own; without items nothing matches; empty input gives no rows; other columns
are not carried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

LENGTH, COVERAGE = 10, 100
#: Words of items in one automaton, and in one piece of an item.
SHARD_WORDS, PIECE = 1 << 18, 1 << 12
#: Bytes of text that are cut into words at once.
SLICE = 4 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = (np.arange(256) >= 128) | ((np.arange(256) >= 48) & (np.arange(256) <= 57)) | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


# ---- the automaton -------------------------------------------------------------------------------------------------

def build(items: list[tuple[int, int, list[int]]], n_words: int) -> dict[str, np.ndarray]:
    """The automaton of (item, limit, words) rows, as arrays: moves (state * n_words + word -> state), suffix links,
    lengths, and what each state reports (state, limit, item), in order."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def state(n: int, out: dict[int, int], to: int) -> int:
        moves.append(out)
        link.append(to)
        length.append(n)
        return len(moves) - 1

    def split(p: int, w: int, q: int) -> int:
        """A state for the runs of ``q`` that are as short as ``p`` and a word."""
        own = state(length[p] + 1, dict(moves[q]), link[q])
        link[q] = own
        while p >= 0 and moves[p].get(w) == q:
            moves[p][w] = own
            p = link[p]
        return own

    def extend(last: int, w: int) -> int:
        q = moves[last].get(w)
        if q is not None:
            return q if length[q] == length[last] + 1 else split(last, w, q)
        new, p = state(length[last] + 1, {}, 0), last
        while p >= 0 and w not in moves[p]:
            moves[p][w] = new
            p = link[p]
        if p >= 0:
            q = moves[p][w]
            link[new] = q if length[q] == length[p] + 1 else split(p, w, q)
        return new

    for _, _, words in items:
        last = 0
        for w in words:
            last = extend(last, w)
    reports = set()
    for item, limit, words in items:
        at, n = 0, 0
        for w in words:
            at, n = moves[at][w], n + 1
            n = min(n, limit)
            while length[link[at]] >= n:
                at = link[at]
            if n == limit:
                reports.add((at, limit, item))
    flat = [(s * n_words + w, t) for s, out in enumerate(moves) for w, t in out.items()]
    report = np.array(sorted(reports), dtype=np.int64).reshape(-1, 3)
    return {"move": np.array([k for k, _ in flat], dtype=np.int64), "to": np.array([t for _, t in flat], dtype=np.int64),
            "link": np.array(link, dtype=np.int64), "length": np.array(length, dtype=np.int64), "report": report}


class Vocabulary:
    """Words of the items, found in a text's bytes by vectorised look-ups; a found word is compared byte by byte."""

    def __init__(self, words: list[bytes]):
        self.depth = max((len(w) + 7) // 8 for w in words)
        chunks = np.frombuffer(b"".join(w.ljust(8 * self.depth, b"\0") for w in words), dtype="<u8").reshape(-1, self.depth)
        name = np.zeros(len(words), dtype=np.uint64)
        for c in range(self.depth):
            live = np.array([len(w) > 8 * c for w in words])
            name[live] = self._named(name[live], chunks[live, c])
        order = np.argsort(name, kind="stable")
        self.name, self.id, self.chunks = name[order], order, chunks[order]
        if len(np.unique(name)) < len(name):
            raise ValueError("two words of the items share a 64-bit name")

    @staticmethod
    def _named(name: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        x = (name ^ chunk) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(31))

    def ids(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for others; ``data`` ends in 8 spare bytes."""
        eight = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
        some = np.flatnonzero(size <= 8 * self.depth)
        name, read = np.zeros(len(some), dtype=np.uint64), []
        for c in range(self.depth):
            live = np.flatnonzero(size[some] > 8 * c) if c else np.arange(len(some))
            at = some[live]
            chunk = eight[start[at] + 8 * c] & _MASK[np.minimum(size[at] - 8 * c, 8)]
            name[live] = self._named(name[live], chunk)
            read.append((live, chunk))
        place = np.minimum(np.searchsorted(self.name, name), len(self.name) - 1)
        same = self.name[place] == name
        for c, (live, chunk) in enumerate(read):
            same[live] &= self.chunks[place[live], c] == chunk
            if len(live) < len(some):
                short = np.ones(len(some), dtype=bool)
                short[live] = False
                same[short] &= self.chunks[place[short], c] == 0
        out = np.full(len(start), -1, dtype=np.int64)
        out[some[same]] = self.id[place[same]]
        return out


class Matcher:
    """One shard, ready to stream documents."""

    def __init__(self, words: list[bytes], items: list[str], arrays: dict[str, np.ndarray], pairs: np.ndarray):
        self.words, self.items, self.pairs = Vocabulary(words), items, pairs
        self.n_words = len(words)
        self.move = dict(zip(arrays["move"].tolist(), arrays["to"].tolist(), strict=True))
        self.link, self.length = arrays["link"].tolist(), arrays["length"].tolist()
        self.report: dict[int, dict[int, list[int]]] = {}
        for s, limit, item in arrays["report"].tolist():
            self.report.setdefault(s, {}).setdefault(limit, []).append(item)
        self.least = int(arrays["report"][:, 1].min())
        # Per state: the nearest state on its suffix links that reports, 0 if none; shorter states come first.
        self.above = [0] * len(self.link)
        for s in np.argsort(arrays["length"], kind="stable").tolist()[1:]:
            p = self.link[s]
            self.above[s] = p if p in self.report else self.above[p]

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """(place, state, longest run, words of the longest match) wherever a match ends."""
        at, run, move, link, length, n = 0, 0, self.move, self.link, self.length, self.n_words
        for k, w in enumerate(ids):
            to = move.get(at * n + w)
            while to is None and at:
                at = link[at]
                run = length[at]
                to = move.get(at * n + w)
            if to is None:
                run = 0
                continue
            at, run = to, run + 1
            if run >= self.least:
                limit = max((t for t in self.report.get(at, ()) if t <= run), default=0)
                if not limit and self.above[at]:
                    limit = max(self.report[self.above[at]])
                if limit:
                    yield k, at, run, limit

    def items_at(self, state: int, run: int) -> Iterator[int]:
        while state:
            for limit, items in self.report.get(state, {}).items():
                if limit <= run:
                    yield from items
            state = self.above[state]


# ---- texts ---------------------------------------------------------------------------------------------------------

class Texts:
    """Some texts as bytes, with the places of their words."""

    def __init__(self, texts: pa.LargeStringArray):
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        self.raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0]:bounds[-1]]
        self.edge = bounds - bounds[0]
        self.data = _LOWER[np.append(self.raw, np.zeros(8, np.uint8))]
        inside = _IS_WORD[self.data]
        first = np.zeros(len(inside), dtype=bool)
        first[self.edge[:-1]] = True
        self.start = np.flatnonzero(inside & (first | ~np.append(False, inside[:-1])))
        first[self.edge[-1]] = True
        self.end = np.flatnonzero(inside[:-1] & (first[1:] | ~inside[1:])) + 1
        #: Number of the first word of each text, and of all words.
        self.word = np.searchsorted(self.start, self.edge)


def stretches(texts: Texts, m: Matcher) -> Iterator[tuple[int, list[int]]]:
    """(first word, word ids) of the stretches in which each pair of neighbours occurs in an item."""
    ids = m.words.ids(texts.data, texts.start, texts.end - texts.start)
    known = ids >= 0
    head = np.zeros(len(ids) + 1, dtype=bool)
    head[texts.word] = True
    two = np.flatnonzero(known[1:] & known[:-1] & ~head[1:len(ids)]) + 1
    pair = ids[two - 1] * m.n_words + ids[two]
    joined = np.zeros(len(ids), dtype=bool)
    if len(m.pairs):
        joined[two] = m.pairs[np.minimum(np.searchsorted(m.pairs, pair), len(m.pairs) - 1)] == pair
    cut = np.append(np.flatnonzero(~joined), len(ids))
    long = np.flatnonzero((np.diff(cut) >= m.least) & known[cut[:-1]])
    for a, b in zip(cut[long].tolist(), cut[long + 1].tolist(), strict=True):
        yield a, ids[a:b].tolist()


def matched(texts: Texts, m: Matcher) -> tuple[np.ndarray, dict[int, set[int]], np.ndarray]:
    """Words inside a match, the items of each text with matches, and each text's longest run with a match."""
    step = np.zeros(len(texts.start) + 1, dtype=np.int64)
    longest = np.zeros(len(texts.word) - 1, dtype=np.int64)
    states: dict[int, set[tuple[int, int]]] = {}
    for a, ids in stretches(texts, m):
        ends = list(m.stream(ids))
        if ends:
            text = int(np.searchsorted(texts.word, a, side="right")) - 1
            at = np.array(ends, dtype=np.int64)
            np.add.at(step, a + at[:, 0] + 1 - at[:, 3], 1)
            np.add.at(step, a + at[:, 0] + 1, -1)
            longest[text] = max(longest[text], at[:, 2].max())
            states.setdefault(text, set()).update((s, min(run, m.length[s])) for _, s, run, _ in ends)
    items = {t: {i for s, run in found for i in m.items_at(s, run)} for t, found in states.items()}
    return np.cumsum(step[:-1]) > 0, items, longest


def _slices(texts: pa.LargeStringArray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``SLICE`` bytes; a longer text is one of its own."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff((np.cumsum(size) - 1) // SLICE, prepend=-1))
    at = [0, *[int(c) for c in cut if c], len(size)]
    return ((a, b) for a, b in zip(at, at[1:], strict=False) if b > a)


def _each(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, Texts]]:
    texts = pc.fill_null(batch.column(text), "").cast(pa.large_string())
    for a, b in _slices(texts):
        yield a, b, Texts(texts.slice(a, b - a))


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def _finder(shard: tuple) -> Callable:
    """Matches of the documents that have any: id, sha, spans (first and next word of each), items, longest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(*shard)
        for batch in batches:
            for a, b, texts in _each(batch, "text"):
                hit, items, longest = matched(texts, m)
                rows = sorted(items)
                spans = []
                for k in rows:
                    lo, hi = _runs(hit[texts.word[k]:texts.word[k + 1]])
                    spans.append(np.column_stack([lo, hi]).ravel().tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(a, b - a).take(pa.array(rows, pa.int64())) for c in ("id", "sha")]
                    + [pa.array(spans, pa.list_(pa.int64())), pa.array([sorted({m.items[i] for i in items[k]}) for k in rows], pa.list_(pa.string())), pa.array(longest[rows], pa.int64())],
                    names=["id", "sha", "spans", "items", "longest"])
    return run


def _described(ids: pa.Array, texts: Texts, hit: np.ndarray, items: dict[int, list[str]], longest: np.ndarray, with_text: bool) -> pa.RecordBatch:
    n = len(ids)
    upto = np.append(0, np.cumsum(hit))
    n_hit = upto[texts.word[1:]] - upto[texts.word[:-1]]
    kept, n_spans = [], np.zeros(n, dtype=np.int64)
    for k in range(n):
        own = hit[texts.word[k]:texts.word[k + 1]] if n_hit[k] else None
        lo, hi = _runs(own) if own is not None else ((), ())
        n_spans[k] = len(lo)
        if with_text:
            a, b, w = int(texts.edge[k]), int(texts.edge[k + 1]), int(texts.word[k])
            cuts = [a, *[int(x) for i, j in zip(lo, hi, strict=True) for x in (texts.start[w + i], texts.end[w + j - 1])], b]
            kept.append(b"".join(texts.raw[x:y].tobytes() for x, y in zip(cuts[::2], cuts[1::2], strict=True)).decode())
    names = [items.get(k, []) for k in range(n)]
    columns = {"id": ids, "n_words": pa.array(np.diff(texts.word), pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(x) for x in names], pa.int64()),
               "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), "contaminated": pa.array(n_hit > 0),
               "n_spans": pa.array(n_spans, pa.int64()), "longest": pa.array(longest, pa.int64()), "items": pa.array(names, pa.list_(pa.string()))}
    if with_text:
        columns["kept"] = pa.array(kept, pa.string())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _describer(shard: tuple | None, with_text: bool) -> Callable:
    """All documents with the matches of one shard, of none, or with those in their columns spans, items, longest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(*shard) if shard else None
        for batch in batches:
            for a, b, texts in _each(batch, "text"):
                if m:
                    hit, found, longest = matched(texts, m)
                    items = {k: sorted({m.items[i] for i in v}) for k, v in found.items()}
                else:
                    hit, items, longest = np.zeros(len(texts.start), dtype=bool), {}, np.zeros(b - a, dtype=np.int64)
                    if "spans" in batch.schema.names:
                        for k, (spans, names, run_) in enumerate(zip(*[batch.column(c).slice(a, b - a).to_pylist() for c in ("spans", "items", "longest")], strict=True)):
                            for lo, hi in zip(*[iter(spans or ())] * 2, strict=True):
                                hit[texts.word[k] + lo:texts.word[k] + hi] = True
                            if names:
                                items[k], longest[k] = sorted(names), run_
                yield _described(batch.column("id").slice(a, b - a), texts, hit, items, longest, with_text)
    return run


# ---- items ---------------------------------------------------------------------------------------------------------

def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shard: its automaton as bytes; rows come sorted by shard."""
    held: list[tuple[str, int, list[str]]] = []

    def made(shard: int) -> pa.RecordBatch:
        number: dict[str, int] = {}
        names = {name: k for k, name in enumerate(sorted({r[0] for r in held}))}
        rows = sorted((names[name], limit, [number.setdefault(w, len(number)) for w in words]) for name, limit, words in held)
        arrays = build(rows, len(number))
        pairs = np.unique(np.array([a * len(number) + b for _, _, w in rows for a, b in zip(w, w[1:], strict=False)], dtype=np.int64))
        data = [arrays[k].tobytes() for k in ("move", "to", "link", "length", "report")] + [pairs.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([list(number)], pa.list_(pa.string())), pa.array([list(names)], pa.list_(pa.string())), pa.array([data], pa.list_(pa.binary()))],
                                          names=["shard", "words", "items", "data"])

    last = None
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["shard"] != last:
                yield made(last)
                held = []
            last = row["shard"]
            held.append((row["item"], row["limit"], row["words"]))
    if held:
        yield made(last)


def item_pieces(items: DataFrame, item_id: str, text: str, length: int, coverage: int) -> DataFrame:
    """(item, limit, piece, words): items as overlapping pieces."""
    lower = F.translate(text_or_empty(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("w"))
    rows = rows.where(F.size("w") > 0).distinct()
    limit = F.least(F.lit(length), F.ceil(F.size("w") * F.lit(coverage) / 100).cast("int"), F.size("w"))
    over = length - 1
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size("w") - over - 1, F.lit(0)) / PIECE).cast("int"))
    rows = rows.select("item", F.greatest(limit, F.lit(1)).alias("limit"), "w", F.explode(starts).alias("piece"))
    return rows.select("item", "limit", "piece", F.slice("w", F.col("piece") * PIECE + 1, F.lit(PIECE + over)).alias("words"))


def automata(items: DataFrame, item_id: str = "item_id", text: str = "text", length: int = LENGTH, coverage: int = COVERAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A written table with one automaton per shard of the items."""
    if length < 1 or not 0 < coverage <= 100:
        raise ValueError("length is at least 1, coverage a percentage above 0")
    pieces = written(item_pieces(items, item_id, text, length, coverage))
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = 1 if total <= shard_words else math.ceil(2 * total / shard_words)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item", "piece", "words"), F.lit(shards)).cast("int"))
    return written(dealt.repartition(shards, "shard").sortWithinPartitions("shard").select("shard", "item", "limit", "words")
                   .mapInArrow(_shards, "shard int, words array<string>, items array<string>, data array<binary>"))


def _loaded(row) -> tuple:
    """What a task needs to make a ``Matcher``."""
    *arrays, pairs = [np.frombuffer(bytes(b), dtype=np.int64) for b in row["data"]]
    named = dict(zip(("move", "to", "link", "length", "report"), arrays, strict=True))
    named["report"] = named["report"].reshape(-1, 3)
    return [w.encode() for w in row["words"]], row["items"], named, pairs


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
            length: int = LENGTH, coverage: int = COVERAGE, shard_words: int = SHARD_WORDS, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_spans, longest, items[, kept]."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_spans long, longest long, items array<string>" + (", kept string" if with_text else "")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    table = automata(items, item_id, item_text, length, coverage, shard_words)
    numbers = sorted(r.shard for r in table.select("shard").collect())
    if len(numbers) < 2:
        shard = _loaded(table.first()) if numbers else None
        return rows.mapInArrow(_describer(shard, with_text), schema).withColumnRenamed("id", "doc_id")
    rows = rows.withColumn("sha", F.sha2(text_or_empty("text").cast("binary"), 256))
    found = None
    for number in numbers:  # one automaton in memory at a time
        part = written(rows.mapInArrow(_finder(_loaded(table.where(F.col("shard") == number).first())), f"id {kind}, sha string, spans array<long>, items array<string>, longest long"))
        found = part if found is None else found.unionByName(part)
    # Equal rows of a document have equal matches; of one document there are as many rows as shards.
    found = found.distinct().groupBy("id", "sha").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("longest").alias("longest"))
    found = written(found.select(F.col("id").alias("of"), F.col("sha").alias("of_sha"), "spans", "items", "longest"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("sha") == F.col("of_sha")), "left").select("id", "text", "spans", "items", "longest")
    return joined.mapInArrow(_describer(None, with_text), schema).withColumnRenamed("id", "doc_id")


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``matches`` as counts: one row per document."""
    return matches(docs, items, **options).drop("items", "longest")
