"""Registered queries of this folder: thin wrappers with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow.llm import (embedding_dedup, exact_dedup, hard_negatives, html_extract, language_id, line_dedup, merkle, mix_sources, ngram_join,
                            pack, secret_scan, substring_dedup, token_count)
from vesselflow.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents")).drop("key")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("kept", "n_spans")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources.plan(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=merkle.one_in_five())


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_dedup, op2_html_extraction, op3_secret_scans, op4_best_fit_packing, op5_ngram_jaccard_join, op6_embedding_near_dedup,
    op7_substring_dedup, op8_language_id, op9_mix_sources, op10_exact_dedup, op11_hard_negatives, op12_merkle_manifest, op13_token_counts)}

# The others have no SQL: pair alignment, HTML trees, tokenizer ids and a trained model are tested otherwise.
SQL: dict[str, str] = {
    "op3_secret_scans": secret_scan.SQL, "op5_ngram_jaccard_join": ngram_join.SQL, "op6_embedding_near_dedup": embedding_dedup.SQL,
    "op7_substring_dedup": substring_dedup.SQL, "op9_mix_sources": mix_sources.SQL, "op10_exact_dedup": exact_dedup.SQL,
    "op11_hard_negatives": hard_negatives.SQL, "op12_merkle_manifest": merkle.SQL}
