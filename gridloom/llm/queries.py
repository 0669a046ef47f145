"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dedup, fingerprints, knn, langid, licences, mixing, oracles, packing, pii, quality, runs, secrets, toxicity
from .common import documents, tokenizer_file


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_file())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(documents(spark, sf_dir), width=4, percent=80)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(documents(spark, sf_dir), plant=True)


def op12_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_packing": op2_packing,
        "op3_toxicity": op3_toxicity,
        "op4_secrets": op4_secrets,
        "op5_language": op5_language,
        "op6_personal_data": op6_personal_data,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_mixing": op8_mixing,
        "op9_licences": op9_licences,
        "op10_quality_rules": op10_quality_rules,
        "op11_runs": op11_runs,
        "op12_quality_votes": op12_quality_votes,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
