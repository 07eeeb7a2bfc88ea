"""The queries opN_<name> over whole tables, and their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import chat, config_packing, divergence, exact_dedup, jaccard_join, line_dedup, media, mixing, quality, resampling, simhash, token_output, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.packed_matrices(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages", "page_id", "url"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_classes(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents", "text", "lang", "source"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": op1_token_output,
        "op2_config_packing": op2_config_packing,
        "op3_chat_format": op3_chat_format,
        "op4_simhash": op4_simhash,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_line_dedup": op6_line_dedup,
        "op7_mix_sources": op7_mix_sources,
        "op8_quality": op8_quality,
        "op9_url_filter": op9_url_filter,
        "op10_media_columns": op10_media_columns,
        "op11_jaccard": op11_jaccard,
        "op12_divergence": op12_divergence,
        "op13_resampling": op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_format": chat.SQL,
        "op5_exact_dedup": exact_dedup.SQL,
        "op6_line_dedup": line_dedup.SQL,
        "op9_url_filter": url_filter.SQL,
        "op12_divergence": divergence.SQL,
        "op13_resampling": resampling.SQL,
    }
