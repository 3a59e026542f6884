"""Problem 1: the 5 most similar vectors for every vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phloem.llm.knn import nearest, neighbour_pairs
from phloem.storage import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(table(spark, sf_dir, "vector_points"), "point_id", "vector", 96, 5, 0.75)
    return neighbour_pairs(found, "point_id", 0.75).select(F.col("id_a").alias("point_id_a"), F.col("id_b").alias("point_id_b"))


def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "vector_points"), "point_id", "vector", 96, 5)


QUERIES = {"p1_found": p1_found, "p1_nearest": p1_nearest}
SQL: dict = {}
