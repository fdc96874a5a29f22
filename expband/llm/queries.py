"""The training-data queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from expband.llm import (attention_lm, chat_log, filter_audit, license_index, line_rules, minhash_tensor, oracles,
                         piece_codec, simhash_leaks, site_quality, substring_dedup, token_alignment,
                         toxicity_cnn, warc_bundles)


def op1_site_quality(spark: SparkSession, sf: str) -> DataFrame:
    return site_quality.of_documents(spark, f"{sf}/documents.parquet", f"{sf}/labels.parquet")


def op2_piece_codec(spark: SparkSession, sf: str) -> DataFrame:
    return piece_codec.of_documents(spark, f"{sf}/documents.parquet")


def op3_warc_bundles(spark: SparkSession, sf: str) -> DataFrame:
    return warc_bundles.of_pages(spark, f"{sf}/pages.parquet")


def op4_chat_log(spark: SparkSession, sf: str) -> DataFrame:
    return chat_log.of_conversations(spark, f"{sf}/conversations.parquet")


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.of_documents(spark, f"{sf}/documents.parquet")


def op6_line_rules(spark: SparkSession, sf: str) -> DataFrame:
    return line_rules.of_documents(spark, f"{sf}/documents.parquet")


def op7_minhash_tensor(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_tensor.of_documents(spark, f"{sf}/documents.parquet")


def op8_license_index(spark: SparkSession, sf: str) -> DataFrame:
    return license_index.of_documents(spark, f"{sf}/documents.parquet")


def op9_simhash_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_leaks.of_documents(spark, f"{sf}/documents.parquet", f"{sf}/benchmark.parquet").drop("distance")


def op10_attention_lm(spark: SparkSession, sf: str) -> DataFrame:
    return attention_lm.of_documents(spark, f"{sf}/documents.parquet")


def op11_toxicity_cnn(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity_cnn.of_documents(spark, f"{sf}/documents.parquet", f"{sf}/labels.parquet").drop("detected_lang")


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.of_documents(spark, f"{sf}/documents.parquet", f"{sf}/labels.parquet")


def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return token_alignment.of_documents(spark, f"{sf}/documents.parquet")


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_site_quality, op2_piece_codec, op3_warc_bundles, op4_chat_log, op5_substring_dedup, op6_line_rules,
        op7_minhash_tensor, op8_license_index, op9_simhash_leaks,
        op10_attention_lm, op11_toxicity_cnn, op12_filter_audit,
        op13_token_alignment, pipeline)}
ORACLES: dict[str, str] = oracles.ORACLES
