"""The ten queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, exact_dedup, html_extract, language_id, near_dedup, packing, piece_sampling, quality_rules, sharding, substring_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": chat_format.op1_chat_formatting,
        "op2_html_extraction": html_extract.op2_html_extraction,
        "op3_language_id": language_id.op3_language_id,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_sharding": sharding.op6_sharding,
        "op7_piece_sampling": piece_sampling.op7_piece_sampling,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
        "op10_quality_rules": quality_rules.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": chat_format.OP1_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op9_minhash_near_dedup": near_dedup.OP9_SQL,
        "op10_quality_rules": quality_rules.OP10_SQL,
    }
