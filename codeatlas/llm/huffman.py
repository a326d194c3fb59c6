"""Canonical length-limited Huffman codes over token ids, written and read in whole arrays."""

from __future__ import annotations

import numpy as np

#: Longest code in bits; a decoding table has 2**LIMIT entries.
LIMIT = 16
#: Ids in a block; every block starts at a stored bit offset and is decoded by itself.
BLOCK = 1024


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Best code length of each symbol (0 where the count is 0) with none above ``limit``, by package-merge."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(symbols) > 1 << limit:
        raise ValueError(f"{len(symbols)} symbols have no code of {limit} bits")
    if len(symbols) < 2:
        lengths[symbols] = 1
        return lengths
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    coins = counts[symbols].astype(np.int64)
    merged, levels = coins, []
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([coins, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(coins))
        merged = both[order]
    take = 2 * len(symbols) - 2
    for is_coin in reversed(levels):
        n = int(is_coin[:take].sum())
        lengths[symbols[:n]] += 1
        take = 2 * (take - n)
    lengths[symbols[:take]] += 1
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    span = np.int64(1) << (LIMIT - size)
    out = np.zeros(len(lengths), dtype=np.uint64)
    out[order] = (np.cumsum(span) - span) >> (LIMIT - size)
    return out


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every LIMIT leading bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (LIMIT - lengths[order].astype(np.int64))
    symbol, size = np.zeros(1 << LIMIT, dtype=np.uint32), np.ones(1 << LIMIT, dtype=np.int64)
    symbol[: span.sum()], size[: span.sum()] = np.repeat(order, span), np.repeat(lengths[order], span)
    return symbol, size


def encode(ids: np.ndarray, code: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ``ids`` (most significant bit first) and the bit offset at which each block starts."""
    if not len(ids):
        return b"", np.zeros(0, dtype=np.int64)
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    word, shift = start >> 6, 64 - (start & 63) - size
    value = code[ids]
    head = np.where(shift >= 0, value << np.maximum(shift, 0).astype(np.uint64), value >> np.maximum(-shift, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(end[-1] + 63 >> 6), dtype=np.uint64)
    out[word[first]] = np.add.reduceat(head, first)
    over = np.flatnonzero(shift < 0)  # at most one code crosses the end of each word
    out[word[over] + 1] += value[over] << (64 + shift[over]).astype(np.uint64)
    return out.astype(">u8").tobytes(), start[::BLOCK]


def decode(data: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ``n`` ids of a stream; all blocks advance together, one id a step."""
    symbol, size = table
    bits = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    at = np.array(offsets, dtype=np.int64)
    out = np.zeros((BLOCK, len(at)), dtype=np.uint32)
    for step in range(min(BLOCK, n)):
        if step == n - (len(at) - 1) * BLOCK:
            at = at[:-1]  # the last block is shorter
        byte = at >> 3
        three = bits[byte] << 16 | bits[byte + 1] << 8 | bits[byte + 2]
        peek = three >> (8 - (at & 7)).astype(np.uint32) & 0xFFFF
        out[step, : len(at)] = symbol[peek]
        at += size[peek]
    return out.T.reshape(-1)[:n]
