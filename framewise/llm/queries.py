"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_ivfpq, bpe, embedding_dedup, filter_audit, hard_negatives, jaccard_join, line_dedup, packing, pii, quality_mil, repetition, toxicity_pu, url_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality_mil.op1_quality,
    "op2_url_filters": url_trie.op2_url_filters,
    "op3_repetition_quality": repetition.op3_repetition_quality,
    "op4_toxicity": toxicity_pu.op4_toxicity,
    "op5_bpe": bpe.op5_bpe,
    "op6_pii": pii.op6_pii,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_nearest": ann_ivfpq.op9_nearest,
    "op10_packing": packing.op10_packing,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_embedding_dedup": embedding_dedup.op13_embedding_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": url_trie.SQL,
    "op3_repetition_quality": repetition.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op12_filter_audit": filter_audit.SQL,
}
