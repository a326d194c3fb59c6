"""Token ids of whole texts, in Arrow batches, by the tokenizers library.

White space separates everything that the tokenizer does: its normalizers compose nothing across it, its
pattern matches none, its added tokens contain none. A Latin letter or digit and an ASCII punctuation tail
after it are separate as well. So a text's ids are those of its words' cores and tails, one after another,
and a piece that returns need not be encoded again. Arrow splits a batch and finds its different pieces;
those not met lately go through the library, the others come from a bounded memory. Words that may hold an
added token stay whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
#: A worker remembers the ids of at most twice so many pieces.
REMEMBERED = 300_000
SLICE_BYTES = 8 << 20
_BYTES = np.arange(256)
ALNUM = np.isin(_BYTES, list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
PUNCTUATION = (_BYTES > 32) & (_BYTES < 127) & ~ALNUM
_OPEN: dict[str, WordEncoder] = {}


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    def __init__(self, name: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids are kept in 16 bits; this tokenizer has more")
        self.ends_word = np.zeros(1 << 16, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ask(self, pieces: list[str]) -> dict[str, bytes]:
        """16-bit ids of pieces by the library. Plain Latin words, one pattern match each, go in lines of many;
        their ids are told apart by the tokens that end a word."""
        plain = [p for p in pieces if p.isalpha() and max(p) <= "\u024f" and "İ" not in p]
        lines = [plain[i:i + 500] for i in range(0, len(plain), 500)]
        known = {}
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, dtype=np.uint16)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(ends) == len(line):
                data = ids.tobytes()
                known.update((w, data[2 * a:2 * b]) for w, a, b in zip(line, [0, *ends], ends, strict=False))
        rest = [p for p in pieces if p not in known]
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[p] = np.asarray(e.ids, dtype=np.uint16).tobytes()
        return known

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        found = [young.get(p) for p in pieces]
        unknown = [i for i, x in enumerate(found) if x is None]
        if unknown:
            new = self.ask([p for p in dict.fromkeys(pieces[i] for i in unknown) if p not in old])
            for i in unknown:
                p = pieces[i]
                if (x := new.get(p)) is None:
                    x = new[p] = old[p]
                found[i] = x
            young.update(new)
            if len(young) > REMEMBERED:
                self.old, self.young = young, {}
        return found

    @staticmethod
    def pieces(words: pa.LargeStringArray) -> pa.LargeStringArray:
        """Core and tail of each word in turn; both views of the words' own bytes."""
        bounds = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
        first, cut = bounds[:-1], bounds[1:].copy()
        moving = np.arange(len(cut))
        while len(moving):  # step back over ASCII punctuation, as long as some word goes on
            moving = moving[cut[moving] > first[moving]]
            moving = moving[PUNCTUATION[data[cut[moving] - 1]]]
            cut[moving] -= 1
        last = np.where(cut > first, data[np.maximum(cut, 1) - 1] if len(data) else 0, 0)
        lead = np.where(cut - 1 > first, data[np.maximum(cut, 2) - 2] if len(data) else 0, 0)
        latin = (lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7))) & ~((lead == 0xC4) & (last == 0xB0))
        whole = ~(ALNUM[last] | (last >= 0x80) & latin)
        if len(words):
            whole |= pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        cut[whole] = bounds[1:][whole]
        both = np.empty(2 * len(words) + 1, dtype=np.int64)
        both[0::2], both[1::2] = bounds, cut
        return pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(both), words.buffers()[2])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts in one array, and the number of ids of each text. Null counts as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        bounds = np.asarray(split.offsets).astype(np.int64)
        coded = self.pieces(split.flatten()).dictionary_encode()
        which = np.asarray(coded.indices)
        seen = coded.dictionary
        # The normalizer lower-cases; doing so for A-Z beforehand changes nothing but an added token.
        lower = pc.if_else(pc.match_substring(seen, "<|"), seen, pc.ascii_lower(seen))
        blobs = self.ids_of(lower.to_pylist())
        sizes = np.fromiter(map(len, blobs), dtype=np.int32, count=len(blobs)) // 2  # a slice has no 2**31 ids
        table = np.frombuffer(b"".join(blobs), dtype=np.uint16)
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        per_piece = sizes[which]
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(per_piece, dtype=np.int32)])
        where = np.repeat(starts[which] - ends[:-1], per_piece)
        where += np.arange(ends[-1], dtype=np.int32)
        return table[where], np.diff(ends[2 * (bounds - bounds[0])]).astype(np.int64)


def encoder(name: str = TOKENIZER) -> WordEncoder:
    """One encoder per worker process."""
    if name not in _OPEN:
        _OPEN[name] = WordEncoder(name)
    return _OPEN[name]


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE_BYTES of text, so that working memory doesn't follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def encoded(batches: Iterator[pa.RecordBatch], doc_id: str, text: str, name: str, end_id: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For each slice: doc_ids, all ids with ``end_id`` after each document, and each document's bounds in them."""
    coder = encoder(name)
    for part in slices(batches, text):
        ids, n = coder.encode(part.column(text))
        ends = np.cumsum(n)
        ids = np.insert(ids, ends, end_id)
        yield part.column(doc_id), ids, np.concatenate([[0], ends + np.arange(1, len(n) + 1)])
