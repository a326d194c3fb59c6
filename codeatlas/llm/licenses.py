"""License scans by template-markup matching.

A template is wording with markup: ``<<beginOptional>> ... <<endOptional>>`` around words that may be absent
(regions may nest), and ``<<var;lo..hi>>`` for a replaceable region of lo to hi arbitrary words. It compiles
into a nondeterministic automaton over tokens; a place of a text is accepted if its mandatory words match
exactly, in order, with nothing but optional and replaceable regions between them. Plain phrases are templates
without markup, so the base places come from the same automata.

Every automaton has words that no accepted place lacks. Texts without any of these are settled by one
vectorised pass per batch (they have no place), the others are run word by word, from every word that can
start an automaton, in time linear in the text for the bounded templates.

Defined results: a null or empty text has no words and no labels; overlapping places count each; repeated
rows are scanned each; empty input gives no rows; other columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .license_texts import TEMPLATES

#: Fixed phrases of the base rule and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_MARK = re.compile(r"<<(beginOptional|endOptional|var;(\d+)\.\.(\d+))>>")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IS_WORD = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")) | (np.arange(256) > 127)


@dataclass
class Automaton:
    """States 0.. with word moves, moves on any word, and free moves; the last state accepts."""

    label: str
    base: bool
    word: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    any: list[int | None] = field(default_factory=lambda: [None])
    free: list[set[int]] = field(default_factory=lambda: [set()])
    mandatory: list[bytes] = field(default_factory=list)

    def state(self) -> int:
        self.word.append({})
        self.any.append(None)
        self.free.append(set())
        return len(self.word) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()] - states:
                states.add(s)
                todo.append(s)
        return states

    def start_words(self) -> set[bytes] | None:
        """Words that can begin an accepted place; None if any word can."""
        first = self.closed({0})
        return None if any(self.any[s] is not None for s in first) else {w for s in first for w in self.word[s]}

    def length_at(self, words: list[bytes], at: int) -> int:
        """Words of the longest accepted place that starts at ``at``, 0 if there is none."""
        now, best, last = self.closed({0}), 0, len(self.word) - 1
        for k in range(at, len(words)):
            now = self.closed({t for s in now for t in (self.word[s].get(words[k]), self.any[s]) if t is not None})
            if not now:
                break
            if last in now:
                best = k - at + 1
        return best


def compile_template(label: str, template: str, base: bool = False) -> Automaton:
    made, at, open_, pos = Automaton(label, base), 0, [], 0

    def wording(piece: str) -> None:
        nonlocal at
        for w in _WORD.findall(piece.encode().lower()):
            to = made.state()
            made.word[at][w] = to
            at = to
            if not open_:
                made.mandatory.append(w)

    for mark in _MARK.finditer(template):
        wording(template[pos:mark.start()])
        pos = mark.end()
        if mark[1] == "beginOptional":
            to = made.state()  # a state of its own, as the way around starts here
            made.free[at].add(to)
            at = to
            open_.append(at)
        elif mark[1] == "endOptional":
            to = made.state()
            made.free[at].add(to)
            made.free[open_.pop()].add(to)
            at = to
        else:
            lo, hi, skips = int(mark[2]), int(mark[3]), []
            for k in range(hi):
                if k >= lo:
                    skips.append(at)
                to = made.state()
                made.any[at] = to
                at = to
            end = made.state()
            for s in [*skips, at]:
                made.free[s].add(end)
            at = end
    wording(template[pos:])
    end = made.state()
    made.free[at].add(end)
    if open_ or not made.mandatory:
        raise ValueError(f"{label}: a region is not closed, or no word is mandatory")
    return made


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is 1 where a template of the method's own accepts a place, 0.6 for a base phrase alone, else 0."""
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    automata = [compile_template(label, phrase, True) for phrase, label in base.items()] + [compile_template(k, t) for k, t in templates.items()]
    kind = docs.schema[doc_id].dataType.simpleString()
    needed = "|".join(sorted({re.escape(max(a.mandatory, key=len).decode()) for a in automata}))
    starts: dict[bytes, list[Automaton]] = {}
    anywhere = []
    for a in automata:
        first = a.start_words()
        anywhere += [a] * (first is None)
        for w in first or ():
            starts.setdefault(w, []).append(a)

    def places(words: list[bytes]) -> tuple[list[int], set[str], set[str]]:
        at, of_base, of_all = [], set(), set()
        for k, w in enumerate(words):
            for a in starts.get(w, ()) if not anywhere else [*starts.get(w, ()), *anywhere]:
                if (a.base or a.label not in of_all) and a.length_at(words, k):
                    of_all.add(a.label)
                    if a.base:
                        at.append(k)
                        of_base.add(a.label)
        return at, of_base, of_all

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(text), "").cast(pa.large_string())
            bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0]:bounds[-1]] if len(texts) else np.zeros(0, np.uint8)
            inside = _IS_WORD[data]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            edges = bounds - (bounds[0] if len(bounds) else 0)
            own = edges[:-1][edges[:-1] < edges[1:]] if len(edges) else edges
            begins[own] = inside[own]  # a text's first byte begins a word whatever ends the text before
            upto = np.concatenate([[0], np.cumsum(begins)])
            n = len(texts)
            n_base, first, last, base_labels, labels, score = np.zeros(n, np.int64), [None] * n, [None] * n, [""] * n, [""] * n, np.zeros(n)
            for k in np.flatnonzero(pc.match_substring_regex(texts, needed, ignore_case=True).to_numpy(zero_copy_only=False)).tolist():
                at, of_base, of_all = places(_WORD.findall(texts[k].as_py().encode().lower()))
                if at:
                    n_base[k], first[k], last[k] = len(at), min(at), max(at)
                base_labels[k], labels[k] = ",".join(sorted(of_base)), ",".join(sorted(of_all))
                score[k] = 1.0 if of_all - of_base else 0.6 if of_base else 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(doc_id), pa.array(upto[edges[1:]] - upto[edges[:-1]], pa.int64()), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                 pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(doc_id, text).mapInArrow(rows, schema)
