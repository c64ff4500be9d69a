"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import chat_format, decontaminate, exact_dedup, hard_negatives, html_extract, language_id, license_scan, rolling_features, sentencepiece_codec, simhash_dedup, token_output, toxicity, warc
from millrace.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_sentencepiece": sentencepiece_codec.query,
        "op3_token_output": token_output.query,
        "op4_toxicity": toxicity.query,
        "op5_warc": warc.query,
        "op6_html_extract": html_extract.query,
        "op7_simhash_dedup": simhash_dedup.query,
        "op8_decontamination": decontaminate.query,
        "op9_license_scan": license_scan.query,
        "op10_chat_format": chat_format.query,
        "op11_hard_negatives": hard_negatives.query,
        "op12_language_id": language_id.query,
        "op13_rolling_features": rolling_features.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op5_warc": warc.ORACLE, "op10_chat_format": chat_format.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op13_rolling_features": rolling_features.ORACLE}
