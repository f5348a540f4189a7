"""One query for each corpus operator, over whole tables, with production parameters; and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, licenses, line_dedup, mixing, repetition, simhash, spm, substring, toxicity, unit_dedup
from .common import documents, span_digest


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).taken()


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).select("doc_id", "n_matches", "license", F.round("dice", 6).alias("dice"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.line_dedup(documents(spark, sf_dir))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(unit_dedup.unit_dedup(documents(spark, sf_dir)))


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(documents(spark, sf_dir)).select("doc_id", "n_tokens", "ids_sha256", "parity", "round_trip")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(substring.substring_dedup(documents(spark, sf_dir)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_mixing, op3_licenses, op4_line_dedup, op5_toxicity, op6_unit_dedup, op7_repetition, op8_exact_dedup, op9_sentencepiece, op10_substring_dedup, pipeline)
}
ORACLES: dict[str, str] = {"op3_licenses": licenses.ORACLE, "op4_line_dedup": line_dedup.ORACLE, "op7_repetition": repetition.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE, "op6_unit_dedup": unit_dedup.ORACLE, "op10_substring_dedup": substring.ORACLE}
