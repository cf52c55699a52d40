"""Registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontamination, divergence, licenses, near_duplicates, packing, pieces, quality, quality_rules, sharding, suffix_dedup, token_counts, toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_centroids": centroids.op11_centroids,
    "op12_divergence": divergence.op12_divergence,
    "op13_pieces": pieces.op13_pieces,
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_quality": quality.op2_quality,
    "op3_sharding": sharding.op3_sharding,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_near_duplicates": near_duplicates.op7_near_duplicates,
    "op8_packing": packing.op8_packing,
    "op9_licenses": licenses.op9_licenses,
}
SQL: dict[str, str] = {
    "op10_decontamination": decontamination.OP10_SQL,
    "op11_centroids": centroids.OP11_SQL,
    "op12_divergence": divergence.OP12_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
}
