"""Evaluation: retrieval metrics of ranked results, judged scores and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phloem.functions.text import lower_collapsed


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, depth: int = 10) -> DataFrame:
    """A row a question with expected terms: first rank whose text holds one, hits at 1, 3 and 5, reciprocal rank, and the terms that any result holds.

    ranked: query_id, rank, text; expected: query_id, terms. Comparison is without case and with blanks collapsed, and
    keeps accents. A question without results has no hit; one without terms has no row.
    """
    kept = F.filter(F.transform("terms", lambda x: F.struct(x.alias("said"), lower_collapsed(x).alias("key"))), lambda x: x["key"] != "")
    terms = expected.select("query_id", kept.alias("terms")).filter(F.size("terms") > 0)
    held = terms.join(ranked.filter(F.col("rank") <= depth).select("query_id", "rank", lower_collapsed(F.coalesce("text", F.lit(""))).alias("text")), "query_id", "left")
    met = held.withColumn("met", F.filter("terms", lambda x: F.coalesce(F.col("text").contains(x["key"]), F.lit(False))))
    first = met.groupBy("query_id").agg(
        F.min(F.when(F.size("met") > 0, F.col("rank"))).alias("first_hit_rank"), F.first("terms").alias("terms"), F.array_distinct(F.flatten(F.collect_list("met"))).alias("met")
    )  # at most ``depth`` rows a question
    matched = F.transform(F.filter("terms", lambda x: F.array_contains("met", x)), lambda x: x["said"])
    at = lambda n: F.coalesce(F.col("first_hit_rank") <= n, F.lit(False)).cast("int").alias(f"hit_at_{n}")
    return first.select("query_id", "first_hit_rank", at(1), at(3), at(5), F.coalesce(F.round(1.0 / F.col("first_hit_rank"), 4), F.lit(0.0)).alias("mrr"), matched.alias("matched_terms"))


def summary(rows: DataFrame, metrics: list[str], by: str = "method") -> DataFrame:
    """Per method the number of rows and the mean of each metric, nulls left out, to four places."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in metrics])
