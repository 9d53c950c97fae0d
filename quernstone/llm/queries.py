"""Queries over whole tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import audio, divergence, langid, licenses, mixing, ngram, packing, simhash, toxicity, urls
from quernstone.llm._common import ship, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.score(table(spark, sf_dir, "pages"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.repetitions(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no audio: each text's UTF-8 bytes are read as 8-bit PCM."""
    return audio.features(table(spark, sf_dir, "documents"), F.col("text"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


_ALL = [
    op1_url_filter, op2_source_mixing, op3_toxicity, op4_audio_features, op5_simhash_dedup,
    op6_distribution_divergence, op7_best_fit_packing, op8_license_scan, op9_lm_scoring, op10_language_id,
]


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": mixing.ORACLE_SQL}
