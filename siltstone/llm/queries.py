"""The registered queries of this folder: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import capdedup, htmltext, mixing, packing, quality, rollups, secrets, simhash, token_files, toxicity
from siltstone.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.maintained(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    ours = (op1_token_files, op2_quality_rules, op3_secret_scans, op4_embedding_near_dedup, op5_simhash_near_dedup, op6_best_fit_packing, op7_toxicity, op8_html_extraction, op9_source_mixing, op10_token_rollups)
    return {f.__name__: f for f in ours}


def oracle_sql() -> dict[str, str]:
    return {"op9_source_mixing": mixing.ORACLE}
