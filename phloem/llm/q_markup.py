"""Problem 3: lines with foreign markup, and clean texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phloem.llm.markup import clean_texts, markup_lines
from phloem.storage import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles, items = table(spark, sf_dir, "articles"), table(spark, sf_dir, "article_items")
    return markup_lines(articles, "articles", "article_id", "body").unionByName(markup_lines(items, "article_items", "item_id", "markdown"))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = clean_texts(table(spark, sf_dir, "articles").select(F.lit("articles").alias("table_name"), F.col("article_id").alias("record_key"), F.col("body").alias("clean")), "clean")
    items = clean_texts(table(spark, sf_dir, "article_items").select(F.lit("article_items").alias("table_name"), F.col("item_id").cast("string").alias("record_key"), F.col("markdown").alias("clean")), "clean")
    return articles.unionByName(items)


QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean}
SQL: dict = {}
