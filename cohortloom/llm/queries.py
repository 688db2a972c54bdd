"""Queries on document texts. None has SQL: tokenization, flows and code pages are beyond it; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import bpe, mixture, mojibake


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_report(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.found(table(spark, d, "documents"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(table(spark, d, "documents")).select("doc_id", "restored_text", "status")


QUERIES = {f.__name__: f for f in (p6_ids, p7_mixture, p7_report, p8_found, p8_restored)}
SQL: dict[str, str] = {}
