"""Registered queries of the training-data operators, and their DuckDB SQL where it can express them."""

from __future__ import annotations

from .centroids import cluster_report
from .common import benchmark, documents, embeddings, labels
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .filter_audit import audit
from .licenses import scan
from .mixing import mixed_counts
from .oracle import ORACLE
from .packing import pack
from .quality_ranker import classify
from .quality_rules import quality_report
from .simhash import near_groups
from .suffix_dedup import suffix_dedup
from .token_files import round_trip
from .toxicity import classify_toxic

QUERIES = {
    "op1_quality_rules": lambda spark, d: quality_report(documents(spark, d)),
    "op2_best_fit_packing": lambda spark, d: pack(documents(spark, d)),
    "op3_mix_sources": lambda spark, d: mixed_counts(documents(spark, d)),
    "op4_quality_ranker": lambda spark, d: classify(documents(spark, d), labels(spark, d)),
    "op5_toxicity_chain": lambda spark, d: classify_toxic(documents(spark, d), labels(spark, d)),
    "op6_license_scan": lambda spark, d: scan(documents(spark, d)),
    "op7_exact_dedup": lambda spark, d: exact_dedup(documents(spark, d)),
    "op8_simhash_dedup": lambda spark, d: near_groups(documents(spark, d)),
    "op9_token_files": lambda spark, d: round_trip(documents(spark, d)),
    "op10_suffix_dedup": lambda spark, d: suffix_dedup(documents(spark, d)),
    "op11_centroid_clusters": lambda spark, d: cluster_report(embeddings(spark, d)),
    "op12_benchmark_decontamination": lambda spark, d: contamination(documents(spark, d), benchmark(spark, d)),
    "op13_filter_audit": lambda spark, d: audit(documents(spark, d), labels(spark, d)),
}

__all__ = ["ORACLE", "QUERIES"]
