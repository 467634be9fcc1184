"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, jaccard_join, line_dedup, lm_scoring, mixing, packing, pii, quality_rules, substring_dedup, threshold_search, token_alignment, topk_search, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_pii": pii.op2_pii,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_topk_search": topk_search.op4_topk_search,
        "op5_packing": packing.op5_packing,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_lm_scoring": lm_scoring.op8_lm_scoring,
        "op9_mixing": mixing.op9_mixing,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "op11_byte_bpe": byte_bpe.op11_byte_bpe,
        "op12_threshold_search": threshold_search.op12_threshold_search,
        "op13_token_alignment": token_alignment.op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op4_topk_search": topk_search.OP4_SQL,
        "op6_jaccard_join": jaccard_join.OP6_SQL,
        "op10_substring_dedup": substring_dedup.OP10_SQL,
        "op12_threshold_search": threshold_search.OP12_SQL,
    }
