"""The thin ``opN_<name>`` queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import article, decontam, interleaved, langid, linededup, minhash, oracles, packing, periodic, pii, prefixcounts, resampling, urlfilter, warc
from ._shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op1(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.op2(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.op3(table(spark, sf_dir, "pages"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op4(table(spark, sf_dir, "documents"))


def op5_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op5(table(spark, sf_dir, "documents"))


def op6_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved.op6(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.op7(table(spark, sf_dir, "pages"))


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op8(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op10(table(spark, sf_dir, "pages"))


def op11_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixcounts.op11(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.op12(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.op13(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
