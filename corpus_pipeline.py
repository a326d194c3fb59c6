"""A training corpus from ``documents``: good documents, one of each group of exact and of near copies, sources
mixed to their weights, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Repeated rows of a document are one document after exact dedup; the mix repeats rows on purpose, and packing
places each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeatlas.llm.common import documents, written
from codeatlas.llm.exact_dedup import keep_one
from codeatlas.llm.mixing import emit
from codeatlas.llm.packing import pack
from codeatlas.llm.quality_rules import keep_good
from codeatlas.llm.simhash import keep_first

STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: keep_good(docs)),
    ("exact_dedup", lambda spark, docs, sf_dir: keep_one(docs)),
    ("simhash_dedup", lambda spark, docs, sf_dir: keep_first(docs)),
    ("mix_sources", lambda spark, docs, sf_dir: emit(docs)),
    ("best_fit_packing", lambda spark, docs, sf_dir: pack(docs)),
]

#: Fingerprints, trees and tokens are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
