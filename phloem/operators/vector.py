"""Vector collections: exact top-k search, payload filters, upsert and delete."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "euclid")
#: Queries that go to the tasks with the plan: at most so many vectors reach the driver.
MAX_QUERIES = 4096


def payload_filter(points: DataFrame, wanted: dict) -> DataFrame:
    """Conditions joined by and: a value must match, a list any of its values, None is no condition."""
    for column, value in wanted.items():
        if value is None:
            continue
        points = points.filter(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return points


def _score(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return x @ q.T
    if metric == "cosine":
        norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
        return np.divide(x @ q.T, norms, out=np.zeros((len(x), len(q))), where=norms > 0)
    return -np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * x @ q.T))


def _keep(kept: pd.DataFrame, batch: pd.DataFrame, ids: list, q: np.ndarray, k: int, metric: str) -> pd.DataFrame:
    """The k best of each query among those kept and a batch of points."""
    score = np.round(_score(np.stack(batch["v"].to_list()), q, metric), 9)
    names = batch["p"].to_numpy()
    top = np.argpartition(-score, min(k, len(names)) - 1, axis=0)
    edge = np.take_along_axis(score, top, 0)[min(k, len(names)) - 1]
    i, j = np.nonzero(score >= edge[None, :])  # with all ties, so that ids decide
    found = pd.DataFrame({"q": [ids[x] for x in j], "p": names[i], "score": score[i, j]})
    return (pd.concat([kept, found]) if len(kept) else found).sort_values(["q", "score", "p"], ascending=[True, False, True]).groupby("q").head(k)


def grid_topk(wanted: DataFrame, points: DataFrame, k: int, metric: str, block: int, cell_rows: int = 20_000) -> DataFrame:
    """(q, p, score): candidates for the k best points of each of very many queries, exactly.

    Queries are cut into blocks and points into cells of bounded size by hashes of their ids; each pair of a block and a
    cell is one task's work and gives at most k rows a query. Every point goes to every block, which is the least that
    an exact search against all points can do.
    """
    n_blocks = max(1, -(-wanted.count() // block))
    n_cells = max(1, -(-points.count() // cell_rows))
    kind, pkind = dict(wanted.dtypes)["q"], dict(points.dtypes)["p"]
    left = wanted.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))))
    right = points.withColumn("c", F.pmod(F.xxhash64("p"), F.lit(n_cells)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def cell(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": [], "p": [], "score": []})]
        for width, group in asked.groupby(asked["v"].map(len)):
            same = there[there["v"].map(lambda v: v is not None and len(v) == width)]
            if len(same):
                out.append(_keep(out[0], same, group["q"].tolist(), np.stack(group["v"].to_list()), k, metric))
        return pd.concat(out[1:]) if len(out) > 1 else out[0]

    return left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInPandas(cell, f"q {kind}, p {pkind}, score double")


def topk(queries: DataFrame, points: DataFrame, k: int, metric: str = "cosine", query_id: str = "query_id", query_vector: str = "vector", point_id: str = "point_id", vector: str = "vector", block: int = 512) -> DataFrame:
    """(query_id, point_id, score, rank): for each query the k best points, exactly; smaller ids first on ties.

    Higher is better; euclid scores are negative distances. Scores are rounded to 9 digits before they are ranked.
    Queries with a null, empty or ragged vector have no result, points with a vector of another length are skipped.
    Up to MAX_QUERIES queries go to the tasks with the plan, in blocks: each task scores a block against its points in one
    matrix product and keeps its own k best, so that k rows a task and query are shuffled whatever the collection's size.
    More queries are joined with the points cell by cell of a grid (``grid_topk``), and never reach the driver.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    wanted = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).filter("v is not null and size(v) > 0")
    asked = wanted.limit(MAX_QUERIES + 1).toPandas()
    if len(asked) > MAX_QUERIES:
        every = points.select(F.col(point_id).alias("p"), F.col(vector).cast("array<double>").alias("v"))
        return _ranked(grid_topk(wanted, every, k, metric, block), k, query_id, point_id)
    kind, pkind = dict(queries.dtypes)[query_id], dict(points.dtypes)[point_id]
    schema = f"q {kind}, p {pkind}, score double"
    parts = []
    for width, group in asked.groupby(asked["v"].map(len)):
        for start in range(0, len(group), block):
            some = group.iloc[start : start + block]
            ids, q = some["q"].tolist(), np.stack(some["v"].to_list())

            def best(batches: Iterator[pd.DataFrame], ids: list = ids, q: np.ndarray = q) -> Iterator[pd.DataFrame]:
                kept = pd.DataFrame({"q": [], "p": [], "score": []})
                for batch in batches:
                    if len(batch):
                        kept = _keep(kept, batch, ids, q, k, metric)
                yield kept

            rows = points.select(F.col(point_id).alias("p"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == int(width))
            parts.append(rows.mapInPandas(best, schema))
    if not parts:
        return queries.sparkSession.createDataFrame([], f"{query_id} {kind}, {point_id} {pkind}, score double, rank int")
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.union(p)
    return _ranked(scored, k, query_id, point_id)


def _ranked(scored: DataFrame, k: int, query_id: str, point_id: str) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "p")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("p").alias(point_id), "score", "rank")


def hold_to(points: DataFrame, **wanted: str) -> DataFrame:
    """``points``, unless a row has another value than wanted (its text mode, its kind): then an error that names it."""
    for column, value in wanted.items():
        other = points.filter(~F.coalesce(F.col(column) == value, F.lit(False))).select(column).limit(1).collect()
        if other:
            raise ValueError(f"{column} is {other[0][0]!r} where {value!r} is expected")
    return points


def upsert(points: DataFrame, changes: DataFrame, key: str = "point_id") -> DataFrame:
    """The collection after the changes: a changed point is replaced as a whole; of several changes to it the last ``seq``."""
    w = Window.partitionBy(key).orderBy(F.desc("seq"))
    last = changes.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "seq")
    return points.join(last.select(key), key, "left_anti").unionByName(last)


def delete(points: DataFrame, ids: DataFrame, key: str = "point_id") -> DataFrame:
    return points.join(ids.select(key).distinct(), key, "left_anti")
