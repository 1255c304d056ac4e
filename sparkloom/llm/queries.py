"""The registered queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, html_extract, license_texts, licenses, line_dedup, media, neardup, packing, token_counts, toxicity
from .common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ADDED = bpe.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"), "page_id", "html", keep=("url",))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text", license_texts.TEMPLATES)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_sensitivity(table(spark, sf_dir, "documents"), "doc_id", "text")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, "doc_id", "text", toxicity.fit(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "toxic"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(table(spark, sf_dir, "documents"), "text", RANKS, PATTERN, ADDED)
    return token_counts.length_histogram(lengths)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_payloads(table(spark, sf_dir, "documents"), "doc_id", "text")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("kept_text").cast("long").alias("n_chars"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), "doc_id", "text", RANKS, PATTERN)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", RANKS, PATTERN, added=ADDED)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_main_text, op2_licenses, op3_fingerprint, op4_near_dedup, op5_toxicity, op6_token_counts, op7_media, op8_line_dedup, op9_bpe, op10_packing)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": neardup.oracle(), "op8_line_dedup": line_dedup.oracle()}
