"""Queries opN_<name> over the driver's tables, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licenses, linededup, oracles, packing, pii, quality, secrets, sharding, simhash, urlfilter
from .base import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.digest(table(spark, sf_dir, "pages"))


def _some(query: Callable[[SparkSession, str], DataFrame], *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query's columns that SQL can express, so that they are compared with it."""
    return lambda spark, sf_dir: query(spark, sf_dir).select("doc_id", *columns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_secret_scan, op3_decontamination, op4_sharding, op5_license_scan,
        op6_quality_rules, op7_simhash, op8_pii, op9_packing, op10_url_filter,
    )
} | {
    "secret_scan_base": _some(op2_secret_scan, "n_assign", "n_access", "n_hex", "base_sha256"),
    "sharding_layout": _some(op4_sharding, "size", "law", "shard", "slot"),
    "license_scan_base": _some(op5_license_scan, "n_words", "n_base", "first_word", "last_word", "base_labels"),
    "quality_rules_base": _some(op6_quality_rules, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
    "pii_base": _some(op8_pii, "n_email", "n_ip", "n_card", "n_phone", "base_sha256"),
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": linededup.ORACLE,
    "op3_decontamination": decontaminate.ORACLE,
    "op10_url_filter": urlfilter.ORACLE,
    "secret_scan_base": oracles.SECRETS,
    "sharding_layout": oracles.SHARDS,
    "license_scan_base": oracles.LICENSES,
    "quality_rules_base": oracles.QUALITY,
    "pii_base": oracles.PERSONAL,
}
