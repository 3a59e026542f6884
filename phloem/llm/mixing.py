"""Sources mixed to target weights: whole copies for certain, the rest by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phloem.storage import Stage


def running_total(df: DataFrame, group: str, order: list, value: str, stage: Stage, total: str = "total") -> DataFrame:
    """``df`` with the running total of ``value`` within ``group`` in the given order, without gathering a group.

    Rows are range-sorted by group and order, each partition adds up its own, and one row a partition and group that it
    holds gives the offsets. Sums are exact for integers.
    """
    names = [f.name for f in df.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", __part long, __local long"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, so_far = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            if not len(batch):
                continue
            local = batch.groupby(group, sort=False)[value].cumsum()
            if batch[group].iloc[0] == last:
                local = local + so_far * (batch[group] == last)
            last, so_far = batch[group].iloc[-1], int(local.iloc[-1])
            yield batch.assign(__part=part, __local=local)

    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = stage.write(df.repartitionByRange(width, group, *order).sortWithinPartitions(group, *order).mapInPandas(add, schema), "running")
    ends = done.groupBy(group, "__part").agg(F.max("__local").alias("__end"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(group, "__part", F.coalesce(F.sum("__end").over(earlier), F.lit(0)).alias("__before"))
    return done.join(offsets, [group, "__part"]).select(*names, (F.col("__local") + F.col("__before")).alias(total))


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None, source: str, size: str, share: str, repeats: str) -> DataFrame:
    """A row a listed source: available size, budget, copies of every record for certain, size left to sample.

    The mix's size is ``total``, or all that the listed sources hold once. A source's budget is its share of it, at most
    what max_repeats copies of its records give; a null or negative share or repeat cap is 0, and a source that is listed
    twice counts with its largest share and cap.
    """
    listed = targets.filter(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.greatest(F.lit(0.0), F.max(F.coalesce(share, F.lit(0.0)))).alias("target_share"), F.greatest(F.lit(0), F.max(F.coalesce(repeats, F.lit(0)))).alias("max_repeats"))
    held = sizes.filter(F.col(size) > 0).groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("available"), F.count("*").alias("records"))
    both = listed.join(held, "source", "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("records", F.coalesce("records", F.lit(0)))
    whole = F.lit(total).cast("double") if total is not None else F.sum("available").over(Window.partitionBy(F.lit(1)))  # one row a listed source
    wanted = both.withColumn("whole", whole).withColumn("wanted", F.round(F.col("target_share") * F.col("whole")).cast("long"))
    capped = wanted.withColumn("budget", F.least("wanted", F.col("available") * F.col("max_repeats")))
    certain = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int")
    return capped.withColumn("certain", certain).withColumn("rest", F.col("budget") - F.col("certain") * F.col("available"))


def inclusion_scales(stage: Stage, rows: DataFrame) -> DataFrame:
    """(source, scale): inclusion probabilities min(1, scale * weight) make a sample of expected size ``rest``.

    Records that reach 1 are certain; what they leave of the rest is allotted to the others anew, until no record
    becomes certain any more. Scales only grow, so every pass but the last makes at least one record certain; one row a
    listed source is written in each. A source whose positive weights are all certain has no scale (null).
    """
    scales = rows.select("source", "rest").distinct().select("source", F.lit(0.0).alias("scale"), F.lit(-1).cast("long").alias("certain"))
    while True:
        sure = F.coalesce(F.col("weight") * F.col("scale") >= 1, F.lit(False))
        summed = rows.join(scales.select("source", "scale"), "source").groupBy("source").agg(
            F.max("rest").alias("rest"), F.sum(F.when(sure, F.col("size")).otherwise(0)).alias("held"), F.sum(F.when(sure, 0.0).otherwise(F.col("weight") * F.col("size"))).alias("open"), F.count_if(sure).alias("now")
        )
        scale = F.when(F.col("open") > 0, F.greatest(F.lit(0.0), F.col("rest") - F.col("held")) / F.col("open"))
        following = stage.write(summed.join(scales.select("source", F.col("scale").alias("was"), "certain"), "source").select("source", F.coalesce(F.greatest("was", scale), "was").alias("scale"), F.col("now").alias("certain"), (F.col("now") > F.col("certain")).alias("moved")), "scales")
        if not following.filter("moved").limit(1).count():
            return following.select("source", "scale")
        scales = following


def mix(docs: DataFrame, targets: DataFrame, id_col: str, size: str = "tokens", source: str = "source", share: str = "target_share", repeats: str = "max_repeats", total: int | None = None, seed: int = 1, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with ``copies``, report a listed source).

    Every record of a source gets the certain copies, and the budget's rest is filled with one more copy of some: each
    record's inclusion probability is its ``weight`` (the column named, or 1) times a scale of its source, at most 1, such
    that the expected size is the rest (``inclusion_scales``); records are ranked by the odds of a random number, hashed
    from id and seed, divided by their inclusion odds (Pareto order sampling), and taken in that order up to the record
    whose end is closest to the rest. So the sample's size is fixed to within half a record, the choice is the same in every run, and
    records of probability 1 come first. A weight that is null, NaN or not positive comes last, when nothing else is left.
    Records without a source, of an unlisted source, or of size 0 or null are not used; no record gets more than
    max_repeats copies. Only listed sources are broadcast, if the optimizer finds them small. Repeated rows are records
    of their own. Where some sources hold too little, the mix falls short of its size: the report has each source's
    share of the size asked for (share_of_total), which meets the target unless capped, and of what was reached.
    """
    stage = Stage(docs.sparkSession, "mixing")
    plan = stage.write(budgets(docs, targets, total, source, size, share, repeats), "plan")
    own = F.col(weight).cast("double") if weight else F.lit(1.0)
    used = docs.filter(F.col(size) > 0).select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"), F.when((own > 0) & ~F.isnan(own), own).otherwise(0.0).alias("weight"))
    rows = stage.write(used.join(plan.filter("budget > 0").select("source", "certain", "rest", "max_repeats"), "source"), "rows")
    rows = rows.join(inclusion_scales(stage, rows), "source")
    pi = F.least(F.lit(1.0), F.greatest(F.lit(1e-12), F.col("scale") * F.col("weight")))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    ranked = rows.withColumn("odds", F.when(F.col("rest") > 0, (u / (1 - u)) * (1 - pi) / pi).otherwise(0.0)).drop("scale")
    summed = running_total(ranked, "source", ["odds", "id"], "size", stage, "reached")
    extra = ((F.col("reached") - F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0) & (F.col("certain") < F.col("max_repeats"))).cast("int")
    chosen = stage.write(summed.select("id", "source", F.col("size").alias("tokens"), (F.col("certain") + extra).alias("copies")).filter("copies > 0"), "chosen")
    reached = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"), F.sum("copies").alias("n_copies"))
    report = plan.join(reached, "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    report = report.withColumn("reached_share", F.col("reached") / F.sum("reached").over(Window.partitionBy(F.lit(1))))
    report = report.withColumn("share_of_total", F.when(F.col("whole") > 0, F.col("reached") / F.col("whole")))
    report = report.select("source", "target_share", "max_repeats", "records", "available", "wanted", "budget", F.coalesce("n_copies", F.lit(0)).alias("n_copies"), "reached", "reached_share", "share_of_total", (F.col("budget") < F.col("wanted")).alias("capped"))
    return chosen.withColumnRenamed("id", id_col), report
