"""The whole pipeline against a version in DuckDB and plain Python, on the smallest tables."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
from xxhash import xxh64_intdigest

import corpus_pipeline
from codeatlas.llm.oracle import ORACLE
from codeatlas.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"


def sql(name: str, docs: pd.DataFrame) -> pd.DataFrame:
    con = duckdb.connect()
    con.register("documents", docs)
    return con.execute(ORACLE[name]).df()


def fingerprint(text: str) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    hashes = [xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def first_of_near(docs: pd.DataFrame) -> pd.DataFrame:
    docs = docs.sort_values("doc_id")
    fp = np.array([fingerprint(t) for t in docs.text], dtype=np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 2
    label = np.arange(len(fp))
    while True:
        new = np.array([label[row].min() for row in near]) if len(fp) else label
        if (new == label).all():
            return docs[label == np.arange(len(fp))]
        label = new


def test_pipeline_against_plain_version(spark):
    from tokenizers import Tokenizer

    docs = duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'").df()
    good = sql("op1_quality_rules", docs)
    docs = docs[docs.doc_id.isin(good[good.kept].doc_id)]
    single = sql("op7_exact_dedup", docs)
    docs = docs[docs.doc_id.isin(single[single.kept].doc_id)]
    docs = first_of_near(docs)
    copies = sql("op3_mix_sources", docs).set_index("doc_id").copies
    tokenizer, want = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), Counter()
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for piece, a in enumerate(range(0, len(ids), 2048)):
            want[doc_id, piece, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes())] += int(copies[doc_id])
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == +want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
