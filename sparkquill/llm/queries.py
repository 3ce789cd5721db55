"""The queries of the operators in this subpackage, each over its whole table with the parameters for production, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, imatch, licenses, ngram_join, packing, ppm, repetition, secrets, simple8b, toxicity
from .frames import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_paths(table(spark, sf_dir, "documents")))


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op4_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.pack(table(spark, sf_dir, "documents"))


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.score(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.identify(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_history(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_license_scan, op2_imatch, op3_ngram_join, op4_simple8b, op5_repetition, op6_byte_bpe, op7_packing, op8_toxicity, op9_language_id, op10_secret_scan)}
ORACLES: dict[str, str] = {"op1_license_scan": licenses.SQL, "op2_imatch": imatch.SQL, "op3_ngram_join": ngram_join.SQL, "op10_secret_scan": secrets.SQL}
