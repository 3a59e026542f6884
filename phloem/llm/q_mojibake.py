"""Problem 10: documents with garbled sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phloem.llm.mojibake import repairs, validation
from phloem.storage import table


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(table(spark, sf_dir, "documents"), "doc_id").select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(table(spark, sf_dir, "documents"), "doc_id")


def p10_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation(table(spark, sf_dir, "documents"))


QUERIES = {"p10_found": p10_found, "p10_restored": p10_restored, "p10_validation": p10_validation}
SQL: dict = {}
