"""Merging writes into the graph's tables: deterministic aggregates instead of read-modify-write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_text(c: str, *order: str) -> Column:
    """The first non-blank text in the given order."""
    return F.min(F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.struct(*order, F.col(c).alias("__v")))).getField("__v")


def set_union(df: DataFrame, key: str, array: str) -> DataFrame:
    """(key, array, n): distinct elements of all rows of a key, sorted, without null and blank; elements are made distinct before they meet."""
    each = df.select(key, F.explode(array).alias("__x")).filter("trim(__x) <> ''").distinct()
    return each.groupBy(key).agg(F.array_sort(F.collect_list("__x")).alias(array), F.count("*").alias(f"n_{array}"))


def merge_entities(writes: DataFrame) -> DataFrame:
    """Entities after all writes, in order of ingested_at: first texts, last type, summed mentions, largest source count, united lists."""
    order = ("ingested_at",)
    base = writes.filter("entity_id is not null").groupBy("entity_id").agg(
        first_text("name", *order).alias("name"),
        first_text("normalized_name", *order).alias("normalized_name"),
        first_text("description", *order).alias("description"),
        F.max(F.struct("ingested_at", "entity_type")).getField("entity_type").alias("entity_type"),
        F.sum(F.coalesce("mention_count", F.lit(0))).alias("mention_count"),
        F.max(F.coalesce("source_count", F.lit(0))).alias("source_count"),
    )
    return base.join(set_union(writes, "entity_id", "aliases"), "entity_id", "left").join(set_union(writes, "entity_id", "surface_forms"), "entity_id", "left")


def replace_texts(table: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of the updates where they are not null, else as they were."""
    new = updates.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return table.join(new, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])
