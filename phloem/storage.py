"""Tables, intermediate results and lineage cuts in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ensure(spark: SparkSession, path: str, schema: str, recreate: bool = False) -> DataFrame:
    """The collection at a path, made empty with the schema if there is none or if it is to be made anew."""
    if recreate or not exists(spark, path):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a collection, 0 if there is none."""
    return spark.read.parquet(path).count() if exists(spark, path) else 0


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or one of our own where a local session names none; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "phloem-checkpoint"))
    return jsc.getCheckpointDir().get()


class Stage:
    """Written intermediate tables of one operator run.

    ``write`` cuts the lineage: the rows are stored as Parquet in the shared folder, so a lost executor costs a
    re-read and never a re-computation of earlier rounds. ``drop`` frees tables that later rounds do not need.
    What a returned DataFrame still reads is removed when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/phloem/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._forget, self.root)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.root}/{self._n:03d}-{name}"
        self._n += 1
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._phloem_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := getattr(df, "_phloem_path", None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _forget(self, path: str) -> None:
        try:
            self._delete(path)
        except Exception:  # the session may be closed already
            pass
