"""Registered queries of this package, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm import (chat_rotation, classifier, decontaminate, line_dedup, lm_scoring,
                           near_dedup, packing, periodic_runs, quality_rules, source_mixing,
                           spelling_variants, suffix_dedup, token_output)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_documents(spark, sf_dir),
                                spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (suffix_dedup.deduplicated(_documents(spark, sf_dir)).drop("spans")
            .withColumn("shortened", F.col("n_removed") > 0))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.report(_documents(spark, sf_dir))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(_documents(spark, sf_dir))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), k=3, percent=85, side=8)


def op8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.report(_documents(spark, sf_dir),
                             spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(_documents(spark, sf_dir), typos=True)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(_documents(spark, sf_dir))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.report(_documents(spark, sf_dir))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}
