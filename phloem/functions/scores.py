"""Score arithmetic: similarities, judged scores and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a vector is all zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def unit_score(c: Column) -> Column:
    """A judged score brought to 0..1: up to 5 is of 5, above that of 10; what is no number is 0."""
    x = F.expr("try_cast(NULL as double)") if c is None else c.try_cast("double")
    scaled = F.when(x > 5, x / 10).when(x > 1, x / 5).otherwise(x)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)), F.lit(0.0))


def verdict(overall: Column, safety: Column) -> Column:
    return F.when(safety < 0.5, "fail").when(overall >= 0.75, "pass").when(overall >= 0.5, "borderline").otherwise("fail")
