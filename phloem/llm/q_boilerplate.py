"""Problem 7: lines of pages outside their article."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phloem.llm.boilerplate import boilerplate_lines
from phloem.storage import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate_lines(table(spark, sf_dir, "article_items"), "item_id")


QUERIES = {"p7_found": p7_found}
SQL: dict = {}
