"""The operators applied to whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contextmix, decontaminate, language, licences, linededup, mixing, pii, quality, secrets, simhash
from .oracles import ORACLE as ORACLE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(pii.find(_table(spark, sf_dir, "documents")), pii.BASE_KINDS)


def op2_contextmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextmix.score(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.learned_and_held_out(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.duplicate_lines(_table(spark, sf_dir, "documents")).drop("th")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_contextmix": op2_contextmix,
    "op3_simhash": op3_simhash,
    "op4_licences": op4_licences,
    "op5_language": op5_language,
    "op6_mixing": op6_mixing,
    "op7_secrets": op7_secrets,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_linededup": op10_linededup,
}
