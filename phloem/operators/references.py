"""References to records that do not exist: orphan detection with declared match semantics."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH = ("simple", "partial", "full")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def null_mask(columns: list[str]) -> Column:
    """Bit i is set where the i-th column is null."""
    return reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)])


def reference_status(
    refs: DataFrame,
    parent: DataFrame,
    keys: list[tuple[str, str]],
    match: str = "simple",
    deleted_at: str | None = None,
    known_at: str | None = None,
    seen_at: str | None = None,
) -> DataFrame:
    """Orphans among the distinct references of ``refs``, with ``orphan_kind``.

    keys: (column of refs, column of parent) for each part of the key. The references are grouped by their null
    mask, and each of the masks that ``match`` lets refer is compared with the parent on its non-null columns:

    * simple: a reference with any null part refers to nothing;
    * partial: the non-null parts must agree with at least one parent row;
    * full: a reference that is null in part is an orphan ('partial_null') whatever the parent holds.

    A reference whose parts are all null never refers. orphan_kind is 'missing' if no parent row agrees, else
    'deleted' if every agreeing row has ``deleted_at``, else 'late' if the smallest ``known_at`` of those rows is
    after the reference's ``seen_at`` (the last two only where those columns are named). Null times are never late.
    An empty parent makes every reference missing; an empty ``refs`` gives no rows. Other columns of ``parent`` are
    not read, so clashing names do no harm; those of ``refs`` are kept.

    Scale: only distinct keys are shuffled to meet the parent (partial aggregation absorbs hot keys, at most one row
    a task and key), and only keys that are orphaned for some row go back to the references, as a broadcast while
    they are small at run time and else as a join that AQE splits on skew.
    """
    if match not in MATCH:
        raise ValueError(f"match must be one of {MATCH}")
    child, width = [c for c, _ in keys], len(keys)
    kept = refs.columns
    tagged = refs.withColumn("__mask", null_mask(child))
    full_mask = (1 << width) - 1
    masks = [0] if match == "simple" else [sum(1 << i for i in gone) for n in range(width) for gone in combinations(range(width), n)]
    out = []
    for mask in masks:
        at = [i for i in range(width) if not mask >> i & 1]
        rows = tagged.filter(F.col("__mask") == mask)
        if mask and match == "full":
            out.append(rows.select(*kept, F.lit("partial_null").alias("orphan_kind")))
            continue
        names = [f"__k{i}" for i in at]
        parents = parent.filter(_all([F.col(keys[i][1]).isNotNull() for i in at])).select(
            *[F.col(keys[i][1]).alias(f"__k{i}") for i in at],
            (F.col(deleted_at).isNull() if deleted_at else F.lit(True)).alias("__live"),
            (F.col(known_at) if known_at else F.lit(None).cast("timestamp")).alias("__known"),
        )
        parents = parents.groupBy(*names).agg(F.max("__live").alias("__live"), F.min("__known").alias("__known"))
        distinct = rows.groupBy(*[F.col(child[i]).alias(f"__k{i}") for i in at]).agg(
            (F.min(seen_at) if seen_at else F.lit(None).cast("timestamp")).alias("__first")
        )
        status = distinct.join(parents, names, "left")
        suspects = status.filter(F.col("__live").isNull() | ~F.col("__live") | (F.col("__known") > F.col("__first"))).drop("__first")
        rows = rows.withColumns({f"__k{i}": F.col(child[i]) for i in at})
        seen = F.col(seen_at) if seen_at else F.lit(None).cast("timestamp")
        kind = F.when(F.col("__live").isNull(), "missing").when(~F.col("__live"), "deleted").when(F.col("__known") > seen, "late")
        found = rows.join(suspects, names, "inner").withColumn("orphan_kind", kind)
        out.append(found.filter(F.col("orphan_kind").isNotNull()).select(*kept, "orphan_kind"))
    assert full_mask not in masks
    return reduce(DataFrame.unionByName, out)


def orphan_report(
    child: DataFrame,
    table_name: str,
    record_key: str,
    field_name: str,
    refs: Column,
    seen_at: str,
    parent: DataFrame,
    parent_key: str,
    deleted_at: str | None,
    known_at: str,
) -> DataFrame:
    """Orphans of one referring field, distinct: table_name, record_key, field_name, ref_key, orphan_kind, period_month.

    refs: the reference, or an array of references; each is read without outer blanks, and a null or blank one is
    no reference. Rows whose ``seen_at`` is null get a null month and are never late.
    """
    blankless = child.select(
        F.col(record_key).cast("string").alias("record_key"), refs.alias("__ref"), F.col(seen_at).alias("__seen")
    )
    is_array = dict(blankless.dtypes)["__ref"].startswith("array")
    each = blankless.withColumn("__ref", F.explode("__ref")) if is_array else blankless
    each = each.withColumn("ref_key", F.nullif(F.regexp_replace("__ref", r"(?U)^\s+|\s+$", ""), F.lit(""))).filter("ref_key is not null")
    found = reference_status(each, parent, [("ref_key", parent_key)], "simple", deleted_at, known_at, "__seen")
    return found.select(
        F.lit(table_name).alias("table_name"),
        "record_key",
        F.lit(field_name).alias("field_name"),
        "ref_key",
        "orphan_kind",
        F.date_format("__seen", "yyyy-MM").alias("period_month"),
    ).distinct()


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, field, kind and month."""
    return found.groupBy("table_name", "field_name", "orphan_kind", "period_month").agg(
        F.count("*").alias("n_references"), F.countDistinct("ref_key").alias("n_keys")
    )
