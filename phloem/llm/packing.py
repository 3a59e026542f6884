"""Items packed into containers of fixed capacity: bulk-synchronous best fit.

Sizes are whole numbers up to a capacity, so items and gaps of one size are classes whose members differ by rank only.
Items are range-sorted by size and ranked within their class on the executors. A round takes one class, from the largest
size down: all its items are matched with the smallest gaps that hold them (their successors), items that want the same
gap are told apart by rank, and the gaps they leave are updated before the next class. Rounds need no rows, only the
classes' counts and which run of containers has which gap; what they decide is applied to all ranked items at once.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phloem.storage import Stage

#: Rows of one range partition, and the most ranks that one size class can have.
_PART_ROWS, _RANKS = 200_000, 1 << 40


def pieces(sizes: DataFrame, limits: dict[int, int], id_col: str, size: str) -> DataFrame:
    """(spec, size, row, piece, id, first_token): every text of a spec as pieces; only one that exceeds the capacity has several.

    row and piece name an item: row is the text's place in its table, so repeated ids are texts of their own.
    """
    each = sizes.filter(F.col(size) > 0).select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(size).cast("long").alias("whole"))
    bounds = F.array(*[F.struct(F.lit(s).cast("long").alias("spec"), F.lit(c).cast("long").alias("capacity")) for s, c in limits.items()])
    crossed = each.withColumn("__b", F.explode(bounds)).select("*", "__b.spec", "__b.capacity")  # every spec packs every item
    cut = crossed.withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("whole") / F.col("capacity")) - 1).cast("int"))))
    first = F.col("piece") * F.col("capacity")
    return cut.select("spec", F.least("capacity", F.col("whole") - first).alias("size"), "row", "piece", "id", first.alias("first_token"))


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows of a partition with their place in their class within it, from 0."""
    part, last, so_far = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        spec, size = batch.column("spec").to_numpy(), batch.column("size").to_numpy()
        fresh = np.r_[True, (spec[1:] != spec[:-1]) | (size[1:] != size[:-1])]
        starts = np.flatnonzero(fresh)
        local = np.arange(len(spec)) - starts[np.cumsum(fresh) - 1]
        if last == (spec[0], size[0]):
            local[: starts[1] if len(starts) > 1 else len(local)] += so_far
        last, so_far = (spec[-1], size[-1]), int(local[-1]) + 1
        names = [*batch.schema.names, "part", "local"]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(spec), part, np.int64)), pa.array(local.astype(np.int64))], names=names)


def best_fit(counts: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, first container, containers, items in each) for (size, count) of all classes of one spec.

    Exactly what best fit by decreasing size gives item by item. Containers of one gap are kept as runs of numbers; a
    round cuts at most two runs, so there are at most three a class, and a run is moved at most sqrt(2 * capacity) times:
    that bounds the result whatever the number of items.
    """
    out: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []  # the gaps that some container has, sorted
    opened = 0
    for size, left in sorted(counts, reverse=True):
        rank, fresh = 0, []

        def take(gap: int, first: int, n: int, each: int) -> None:
            nonlocal left, rank
            out.append((size, rank, first, n, each))
            rank, left = rank + n * each, left - n * each
            if gap > each * size:
                fresh.append((gap - each * size, first, n))

        at = bisect.bisect_left(gaps, size)
        while left and at < len(gaps):
            gap, held = gaps[at], runs[gaps[at]]
            while left and held:
                first, n = held.pop()
                each = min(gap // size, left)
                some = min(n, left // each)
                take(gap, first, some, each)
                if some < n:
                    held.append((first + some, n - some))
            if not held:
                del runs[gap], gaps[at]
        while left:
            each = min(capacity // size, left)
            n = left // each
            take(capacity, opened, n, each)
            opened += n
        for gap, first, n in fresh:
            if gap not in runs:
                runs[gap] = []
                bisect.insort(gaps, gap)
            runs[gap].append((first, n))
    return out


def pack(sizes: DataFrame, specs: DataFrame, id_col: str, size: str = "tokens", spec: str = "spec_id", capacity: str = "capacity_tokens") -> DataFrame:
    """(spec, container_id, id, piece, first_token, tokens): every text in exactly one container of each spec.

    A text is split only if it alone exceeds the capacity: into pieces of the capacity and a rest. Items of size 0 or
    null are not packed; a capacity that is null or not positive packs nothing, the largest capacity of a repeated spec
    counts; empty tables give no rows.

    Items are shuffled once, by a range sort on size that also splits classes of very many items; partitions are bounded
    by rows. Each spec's rounds run in one task over its classes, at most as many as its capacity (``best_fit`` gives the
    bound of what they decide, which is broadcast); neither grows with the number of items.
    """
    spark = sizes.sparkSession
    stage = Stage(spark, "packing")
    limits = {r["spec"]: r["capacity"] for r in specs.filter(F.col(capacity) > 0).groupBy(F.col(spec).alias("spec")).agg(F.max(capacity).alias("capacity")).collect()}
    if not limits:
        return sizes.select(F.lit(None).cast("long").alias(spec), F.lit(None).cast("long").alias("container_id"), F.col(id_col), F.lit(None).cast("int").alias("piece"), F.lit(None).cast("long").alias("first_token"), F.lit(None).cast("long").alias("tokens")).filter("false")
    items = pieces(sizes, limits, id_col, size)
    n_parts = math.ceil(max(1, items.count()) / _PART_ROWS)
    order = ["spec", "size", "row", "piece"]
    schema = items.drop("row").schema.add("part", "long").add("local", "long")
    sorted_items = items.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).drop("row")
    ranked = stage.write(sorted_items.mapInArrow(_ranked, schema), "ranked")
    ends = ranked.groupBy("spec", "size", "part").agg((F.max("local") + 1).alias("n"))  # a class and the partitions that it spans

    def rounds(frame: pd.DataFrame) -> pd.DataFrame:
        counts = frame.groupby("size")["n"].sum()
        spec_id = int(frame["spec"].iloc[0])
        found = best_fit([(int(s), int(n)) for s, n in counts.items()], int(limits[spec_id]))
        return pd.DataFrame([(spec_id, *x) for x in found], columns=["spec", "size", "low", "first", "n", "each"])

    decided = ends.groupBy("spec").applyInPandas(rounds, "spec long, size long, low long, first long, n long, each long").toPandas()
    decided = decided.sort_values(["spec", "size", "low"], ignore_index=True)
    spans = ends.toPandas().sort_values(["spec", "size", "part"], ignore_index=True)
    spans["before"] = spans.groupby(["spec", "size"])["n"].cumsum() - spans["n"]
    classes = pd.MultiIndex.from_frame(decided[["spec", "size"]].drop_duplicates())
    shared = spark.sparkContext.broadcast(
        (
            classes.get_level_values(0).to_numpy(), classes.get_level_values(1).to_numpy(),
            classes.get_indexer(pd.MultiIndex.from_frame(spans[["spec", "size"]])) if len(spans) else np.zeros(0, np.int64), spans["part"].to_numpy(), spans["before"].to_numpy(),
            (classes.get_indexer(pd.MultiIndex.from_frame(decided[["spec", "size"]])) if len(decided) else np.zeros(0, np.int64)) * _RANKS + decided["low"].to_numpy(), *(decided[c].to_numpy() for c in ("low", "first", "each")),
        )
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_spec, class_size, span_class, span_part, span_before, keys, low, first, each = shared.value
        width = int(class_size.max()) + 1 if len(class_size) else 1
        class_key, span_key = class_spec * width + class_size, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.searchsorted(class_key, batch.column("spec").to_numpy() * width + batch.column("size").to_numpy())
            part = batch.column("part").to_numpy()
            if span_key is None:
                most = int(span_part.max()) + 1
                span_key = span_class * most + span_part
            rank = batch.column("local").to_numpy() + span_before[np.searchsorted(span_key, at * most + part)]
            run = np.searchsorted(keys, at * _RANKS + rank, side="right") - 1
            container = first[run] + (rank - low[run]) // each[run]
            columns = [batch.column("spec"), pa.array(container.astype(np.int64)), batch.column("id"), batch.column("piece"), batch.column("first_token"), batch.column("size")]
            yield pa.RecordBatch.from_arrays(columns, names=["spec", "container_id", "id", "piece", "first_token", "tokens"])

    kind = dict(ranked.dtypes)["id"]
    out = ranked.mapInArrow(assign, f"spec long, container_id long, id {kind}, piece int, first_token long, tokens long")
    return out.withColumnRenamed("spec", spec).withColumnRenamed("id", id_col)


def fill_report(packed: DataFrame, specs: DataFrame, spec: str = "spec_id", capacity: str = "capacity_tokens") -> DataFrame:
    """A row a spec: containers, items, tokens, the fewest containers that the total size allows, and the share of space used."""
    per = packed.groupBy(spec).agg(F.countDistinct("container_id").alias("containers"), F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return per.join(specs.select(spec, capacity).distinct(), spec).withColumn("least_containers", F.ceil(F.col("tokens") / F.col(capacity))).withColumn("used", F.col("tokens") / (F.col("containers") * F.col(capacity)))
