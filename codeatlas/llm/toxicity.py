"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models on the words of a text, each model also seeing the
probabilities that the earlier ones gave. While training, those probabilities are out-of-fold: a row's come from
models that never saw it, so later models learn how far earlier ones can be trusted on new texts.

The labels table marks toxic texts as a whole. The two finer categories that open the chain are labelled from it,
without word lists: in each language, the features most typical of its toxic training rows are dealt to the
categories so that each covers about as many of these rows, and a toxic text with a feature of a category belongs to
it. Features typical of all toxic training rows count in every language, so that languages with few labels are not
left out. A toxic text without any typical feature is in neither. The last category is the label itself.

A model's features are hashed words and word beginnings (4 to 7 bytes, so that forms of one stem meet): those
whose presence differs most surely between classes (two-proportion z), at most ``MAX_WORDS``. Each gives two
inputs, its presence, so that one plain word counts in a text of any length, and its rate among all words.

Only the fit is bounded: at most ``PER_CLASS`` labelled rows of each class, chosen by hash of the id. Every whole
text is scored, in Arrow batches.

Defined results: null or empty texts have no words and get the models' base probabilities; without both classes
among the training rows a category's probability is its share; repeated rows are scored each; empty input gives
no rows; other columns are not carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_ranker import held_out, labelled_sample
from .tokens import slices

PER_CLASS = 3000
#: The chain's first categories, made of the features typical of toxic training rows.
CATEGORIES = ("typical_1", "typical_2")
#: Typical features of a language at most.
MAX_TYPICAL = 32
HASHES = 1 << 20
#: Words of which a worker remembers the features.
MEMO = 300_000
MAX_WORDS = 192
BEGINNINGS = (4, 5, 6, 7)
FOLDS = 3
_WORD = re.compile(rb"[a-z\x80-\xff]+")
_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz")) | (np.arange(256) > 127)


def _hashes(word: bytes) -> list[int]:
    """The features of a word: itself, and its beginnings."""
    from xxhash import xxh32_intdigest

    return [xxh32_intdigest(w) % HASHES for w in (word, *(word[:k] + b"*" for k in BEGINNINGS if len(word) > k))]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """For every word of the texts, its text's number and its number among the different words; and those."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if bounds[0] == bounds[-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    data, bounds = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[bounds[0]:bounds[-1]].copy(), bounds - bounds[0]
    data[(data >= 65) & (data <= 90)] += 32
    inside = _LETTER[data]
    # Runs of letters and of others in turn, cut at the texts' ends too.
    runs = np.union1d(np.flatnonzero(np.diff(inside)) + 1, bounds)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(runs) - 1, [None, pa.py_buffer(runs.astype(np.int64)), pa.py_buffer(data)])
    word = np.flatnonzero(inside[runs[:-1]])
    coded = pieces.take(pa.array(word)).dictionary_encode()
    return np.searchsorted(bounds, runs[word], side="right") - 1, np.asarray(coded.indices), coded.dictionary.to_pylist()


def feature_counts(of: np.ndarray, which: np.ndarray, n_words: int, n_texts: int, pairs: list[tuple[int, int]], n_features: int) -> np.ndarray:
    """How often each text has each feature."""
    out = np.zeros(n_texts * max(n_features, 1))
    marked = np.zeros(n_words, dtype=bool)
    marked[[k for k, _ in pairs]] = True
    here = np.flatnonzero(marked[which]) if len(which) else np.zeros(0, np.int64)
    features: dict[int, list[int]] = {}
    for k, f in pairs:
        features.setdefault(k, []).append(f)
    for text, word in zip(of[here].tolist(), which[here].tolist(), strict=True):
        for f in features[word]:
            out[text * n_features + f] += 1
    return out.reshape(n_texts, -1)[:, :n_features]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights and intercept (last) by Newton's method with a ridge on the weights."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-3:
            break
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def surest(present: list[np.ndarray], c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How surely each hash's presence differs between the classes of ``c`` (two-proportion z, positive in class 1), and how many rows have it."""
    seen, n = np.bincount(np.concatenate(present), minlength=HASHES).astype(float), len(present)
    inside = np.bincount(np.concatenate([p for p, on in zip(present, c, strict=True) if on]), minlength=HASHES)
    a, b, share = inside / c.sum(), (seen - inside) / (n - c.sum()), seen / n
    return (a - b) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / c.sum() + 1 / (n - c.sum()))), seen


def select_words(present: list[np.ndarray], y: np.ndarray, most: int = MAX_WORDS) -> np.ndarray:
    """Hashes whose presence differs most surely between the classes of any category (columns of ``y``)."""
    best, seen = np.zeros(HASHES), np.zeros(HASHES)
    for c in y.T:
        if 0 < c.sum() < len(present):
            z, seen = surest(present, c)
            best = np.maximum(best, np.abs(z))
    best[seen < 3] = 0
    chosen = np.argsort(-best, kind="stable")[:most]
    return np.sort(chosen[best[chosen] >= 5])


def typical_groups(present: list[np.ndarray], langs: list, toxic: np.ndarray, n_groups: int) -> np.ndarray:
    """Which rows (by n_groups) are toxic and hold a feature of a group, groups being made per language and once over all."""
    out = np.zeros((len(present), n_groups), dtype=bool)
    of = {lang: np.array([k for k, x in enumerate(langs) if x == lang]) for lang in set(langs)}
    for rows in [*of.values(), *([np.arange(len(langs))] if len(of) > 1 else [])]:
        c = toxic[rows]
        if not 0 < c.sum() < len(rows):
            continue
        z, seen = surest([present[k] for k in rows], c)
        z[seen < 3] = 0
        chosen = np.argsort(-z, kind="stable")[:MAX_TYPICAL]
        chosen = chosen[z[chosen] >= 5]
        own, covered = rows[c == 1], np.zeros((int(c.sum()), n_groups), dtype=bool)
        for has in np.array([np.isin(chosen, present[k]) for k in own]).T:
            covered[:, covered.sum(axis=0).argmin()] |= has
        out[own] |= covered
    return out


def inputs(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Presence and rate (on a log scale) of each feature in each text."""
    return np.hstack([counts > 0, np.log1p(200 * counts / np.maximum(n_words, 1)[:, None])]).astype(float)


def fit_chain(rows: list, n_groups: int) -> dict:
    """{"words": hashes, "chain": weights per category} from (doc_id, hashes, counts, n_words, lang, y) rows."""
    rows = sorted(rows, key=lambda r: r["doc_id"])
    present = [np.frombuffer(r["hashes"], dtype=np.int32) for r in rows]
    toxic = np.array([r["y"] for r in rows], dtype=float)
    y = np.column_stack([typical_groups(present, [r["lang"] for r in rows], toxic, n_groups), toxic]).astype(float)
    words = select_words(present, y) if rows else np.zeros(0, np.int64)
    counts = np.zeros((len(rows), len(words)))
    for k, (p, r) in enumerate(zip(present, rows, strict=True)):
        _, own, at = np.intersect1d(p, words, assume_unique=True, return_indices=True)
        counts[k, at] = np.frombuffer(r["counts"], dtype=np.int32)[own]
    x = inputs(counts, np.array([r["n_words"] for r in rows], dtype=float))
    fold, chain = np.arange(len(rows)) % FOLDS, []
    for c in y.T:
        if not len(c) or c.min() == c.max():
            chain.append(np.append(np.zeros(x.shape[1]), np.log((c.mean() + 1e-9) / (1 - c.mean() + 1e-9)) if len(c) else 0.0))
            out = np.full(len(c), c.mean() if len(c) else 0.5)
        else:
            out = np.empty(len(c))
            for f in range(FOLDS):
                out[fold == f] = _probability(x[fold == f], _logistic(x[fold != f], c[fold != f]))
            chain.append(_logistic(x, c))
        x = np.hstack([x, out[:, None]])
    return {"words": words, "chain": chain}


def sampled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For training rows: the different features of a text with their counts."""
    for batch in batches:
        out = {"hashes": [], "counts": [], "n_words": []}
        for t in batch.column("text"):
            words = Counter(_WORD.findall((t.as_py() or "").encode().lower()))
            got = [(h, n) for w, n in words.items() for h in _hashes(w)]
            hashes, which = np.unique(np.array([h for h, _ in got], dtype=np.int32), return_inverse=True)
            counts = np.bincount(which, [n for _, n in got], len(hashes)).astype(np.int32)
            for k, v in zip(out, (hashes.tobytes(), counts.tobytes(), sum(words.values())), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out["hashes"], pa.binary()), pa.array(out["counts"], pa.binary()), pa.array(out["n_words"], pa.int64()),
             batch.column("lang"), batch.column("y")], names=["doc_id", *out, "lang", "y"])


def classify_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", categories: tuple[str, ...] = CATEGORIES, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, p_<category>..., score (of ``label``), predicted int, is_toxic boolean."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = labelled_sample(docs, labels, label, per_class, ("lang",)).mapInArrow(
        sampled_features, f"doc_id {kind}, hashes binary, counts binary, n_words long, lang string, y int")
    model = fit_chain(sample.collect(), len(categories))  # at most 2 * per_class rows
    words, chain, names = model["words"], model["chain"], [f"p_{c}" for c in categories] + ["score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, memo = {int(h): k for k, h in enumerate(words)}, {}
        for part in slices(batches, "text"):
            of, which, different = words_of(part.column("text"))
            pairs = []  # (different word, feature)
            for k, w in enumerate(different):
                if (hit := memo.get(w)) is None:
                    hit = memo[w] = tuple({number[h] for h in _hashes(w) if h in number})
                pairs += [(k, f) for f in hit]
            if len(memo) > MEMO:
                memo = {}
            occurs = feature_counts(of, which, len(different), part.num_rows, pairs, len(words))
            x = inputs(occurs, np.bincount(of, minlength=part.num_rows))
            for w in chain:
                x = np.hstack([x, _probability(x, w)[:, None]])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x[:, 2 * len(words) + k]) for k in range(len(chain)))], names=["doc_id", *names])

    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, " + ", ".join(f"{n} double" for n in names))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *names, F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), (F.col("score") >= 0.5).alias("is_toxic"))
