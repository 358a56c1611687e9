"""Registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm import (
    alignment, byte_bpe, decontamination, exact_dedup, language_id, passage_dedup, prefix_counts, quality, simhash, subvectors, suffix_dedup, token_blocks,
    toxicity)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(_table(spark, sf_dir, "documents"))


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_files(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.near_passages(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.token_counts(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(_table(spark, sf_dir, "documents"))


def op13_subvectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subvectors.centroid_clusters(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_blocks": op2_token_blocks,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_paragraph_dedup": op6_paragraph_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_prefix_counts": op11_prefix_counts,
    "op12_alignment": op12_alignment,
    "op13_subvectors": op13_subvectors,
}

ORACLES = {
    "op4_decontamination": decontamination.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op13_subvectors": subvectors.oracle(),
}
