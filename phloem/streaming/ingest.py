"""Incremental ingest: files that arrive are merged into a table, batch by batch, and each is taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from phloem.operators.graph import latest


def ingest_stream(spark: SparkSession, incoming: str, target: str, checkpoint: str, schema: StructType, key: str = "article_id", seen_at: str = "ingested_at") -> StreamingQuery:
    """Take in all Parquet files that are there, then stop: a resumable run as its checkpoint remembers what it took.

    Every batch appends to a table of writes, partitioned by batch, so a batch that is run again after a failure replaces
    its own rows and nothing else. ``current`` reads the state.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target)

    stream = spark.readStream.schema(schema).parquet(incoming)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, key: str = "article_id", seen_at: str = "ingested_at") -> DataFrame:
    """The last write of each key."""
    return latest(spark.read.parquet(target), key, seen_at, "batch_id").drop("batch_id")


def windowed_counts(events: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours", *by: str) -> DataFrame:
    """Counts a window and group, with a watermark, so that state is dropped once no late row may come; works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")
