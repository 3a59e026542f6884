"""Problem 4: entities whose fields read the same but differ in characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phloem.llm.lookalike import alike_classes, alike_pairs, field_values, model_counts, with_form
from phloem.storage import table

_FIELDS = ["name", "normalized_name", "aliases"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = alike_pairs(table(spark, sf_dir, "entities"), "entity_id", _FIELDS)
    return pairs.select("field_name", F.col("id_a").alias("entity_id_a"), F.col("id_b").alias("entity_id_b"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = field_values(table(spark, sf_dir, "entities"), "entity_id", _FIELDS).distinct()
    counts = model_counts(values.select(F.col("value").alias("text")))
    return with_form(values, "value", counts).select("field_name", F.col("id").alias("entity_id"), "value", "form")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_classes(table(spark, sf_dir, "entities"), "entity_id", _FIELDS).withColumnRenamed("id", "entity_id")


QUERIES = {"p4_found": p4_found, "p4_classes": p4_classes, "p4_forms": p4_forms}
SQL: dict = {}
