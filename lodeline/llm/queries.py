"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, lines, media, mixing, packing, quality, simhash, tokens, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": tokens.query,
        "op2_simhash": simhash.query,
        "op3_toxicity": toxicity.query,
        "op4_quality_rules": quality.query,
        "op5_best_fit_packing": packing.query,
        "op6_chat_formatting": chat.query,
        "op7_source_mixing": mixing.query,
        "op8_url_filters": urls.query,
        "op9_line_dedup": lines.query,
        "op10_media_columns": media.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality.ORACLE}
