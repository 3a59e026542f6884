"""The k most similar vectors for every vector: probed lists scanned by adaptive dimension blocks.

Points are unit vectors under a random rotation, so that any block of dimensions is a fair sample of a distance. Lists
are the cells of centroids trained on a bounded sample; every row is indexed. A point is scanned against its own list
and against the lists whose centroids are nearly as close. Within a list, partial distances over the first dimensions
are scaled up to an estimate, and a hypothesis test abandons candidates whose estimate cannot belong to the k best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phloem.storage import Stage

#: Rows of the training sample for each list.
SAMPLE_ROWS = 48
_SCALE = 32_767.0


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the lists of ``dim`` finite numbers that are not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
    offsets = column.offsets.to_numpy()
    values = column.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)  # nulls become NaN
    good = (np.diff(offsets) == dim) & (np.ones(n, bool) if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False))
    at = np.flatnonzero(good)
    x = flat[offsets[at][:, None] + np.arange(dim)] if len(at) else np.zeros((0, dim), np.float32)
    with np.errstate(all="ignore"):
        norms = np.linalg.norm(x.astype(np.float64), axis=1)
    fine = np.isfinite(norms) & (norms > 0)
    return at[fine], (x[fine] / norms[fine, None]).astype(np.float32)


def train_lists(sample: np.ndarray, n_lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means centroids of a sample of unit vectors; a cell that runs empty keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:n_lists]].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[i : i + 4096] @ c.T, axis=1) for i in range(0, len(sample), 4096)])
        order = np.argsort(near, kind="stable")
        cells, starts = np.unique(near[order], return_index=True)
        c[cells] = np.add.reduceat(sample[order], starts, axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def list_centroids(rows: DataFrame, n: int, dim: int, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of about 1.6 sqrt(n) lists, and the share of the sample in each; trained in two levels.

    The driver trains the square root of the lists' number on SAMPLE_ROWS rows each; a sample of SAMPLE_ROWS rows a list
    then goes to those, and each trains its part of the lists in a task of its own. The sample is chosen by a hash of the
    id. Dense places have more upper centroids, so a task's sample stays near SAMPLE_ROWS times their number.
    """
    n_lists = math.ceil(1.6 * math.sqrt(n))
    upper = math.ceil(math.sqrt(n_lists))

    def part(want: int) -> DataFrame:
        return rows if n <= want else rows.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, want / n)) + 1)

    first = unit_rows(part(SAMPLE_ROWS * max(upper, 16)).select("vector").toArrow()["vector"], dim)[1] @ turn
    if not len(first):
        return np.zeros((0, dim), np.float32), np.zeros(0)
    shared = rows.sparkSession.sparkContext.broadcast((turn, train_lists(first, min(upper, len(first)))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, tops = shared.value
        for batch in batches:
            x = unit_rows(pa.concat_arrays([batch.column("vector")]), dim)[1] @ turn
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.argmax(x @ tops.T, axis=1).astype(np.int32)), pa.array([v.tobytes() for v in x], pa.binary())], names=["upper", "v"])

    def train(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float32).reshape(-1, dim)
        x = x[np.lexsort(x.T[:4])]  # the same order in every run
        c = train_lists(x, max(1, round(len(x) / SAMPLE_ROWS)))
        held = np.bincount(np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)]), minlength=len(c))
        return pa.table({"c": pa.array([v.tobytes() for v in c.astype(np.float32)], pa.binary()), "held": pa.array(held.astype(np.int64))})

    got = part(SAMPLE_ROWS * n_lists).select("vector").mapInArrow(assign, "upper int, v binary").groupBy("upper").applyInArrow(train, "c binary, held long").toArrow()
    centroids = np.frombuffer(b"".join(got["c"].to_pylist()), np.float32).reshape(-1, dim)
    held = np.asarray(got["held"], dtype=float)
    return centroids.copy(), held / held.sum()


def list_blocks(share: np.ndarray, n: int, block_rows: int) -> np.ndarray:
    """Blocks of each list: more than one only above ``block_rows`` and four times the mean, so at most 1.25 a list in all."""
    return np.maximum(1, np.ceil(share * n / max(block_rows, 4 * n / len(share)))).astype(np.int64)


def apart(stage: Stage, rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows without those that have k + 1 equal vectors of smaller id before them, and what those rows get as neighbours.

    Classes of equal vectors are found over the whole collection by two hashes of the vector, counted on the map side.
    The second result is (id, neighbour, similarity) of the rows taken out, or None if there are none.
    """
    named = rows.withColumn("h", F.xxhash64("vector")).withColumn("g", F.hash("vector"))
    often = stage.write(named.groupBy("h", "g").agg(F.count("*").alias("n")).filter(F.col("n") > k + 1).select("h", "g"), "often")
    if not often.limit(1).count():
        return rows, None
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = stage.write(named.join(often, ["h", "g"], "left_semi").filter(finite & F.exists("vector", lambda x: x != 0)).select("id", "h", "g").distinct(), "held")
    place = F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))
    first = stage.write(held.withColumn("place", place).filter(F.col("place") <= k + 1), "first")  # each task keeps k + 1 rows of a class before the shuffle
    rest = stage.write(held.join(first.select("id", "h", "g"), ["id", "h", "g"], "left_anti"), "rest")
    near = first.filter(F.col("place") <= k).select("h", "g", F.col("id").alias("neighbour"))
    extra = rest.join(near, ["h", "g"]).select("id", "neighbour", F.lit(1.0).alias("similarity"))
    return named.join(rest, ["id", "h", "g"], "left_anti").select("id", "vector"), extra


def _first_copies(codes: np.ndarray, ids: np.ndarray, k: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Equal vectors as classes (rows by class and id, where each class starts, each row's class), and whether a row is one of its class's first k + 1."""
    codes = np.ascontiguousarray(codes)
    _, same = np.unique(codes.view(np.dtype((np.void, codes.dtype.itemsize * codes.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same)) if len(np.unique(same)) < len(same) else np.argsort(same)
    first = np.r_[True, same[order][1:] != same[order][:-1]]
    starts = np.flatnonzero(first)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids)) - starts[np.cumsum(first) - 1]
    return (order, starts, same), place <= k


def _merge(best: tuple[np.ndarray, np.ndarray], rows: np.ndarray, other: np.ndarray, dist: np.ndarray, k: int) -> None:
    """Take candidates (row, other, dist) into the k best of each row; equal distances go to the smaller index."""
    if not len(rows):
        return
    ids, dists = best
    touched = np.unique(rows)
    all_rows = np.concatenate([np.repeat(touched, k), rows])
    all_ids = np.concatenate([ids[touched].ravel(), other])
    all_dist = np.concatenate([dists[touched].ravel(), dist])
    order = np.lexsort((all_ids, all_dist, all_rows))
    r = all_rows[order]
    first = np.r_[True, r[1:] != r[:-1]]
    place = np.arange(len(r)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    keep = place < k
    ids[r[keep], place[keep]] = all_ids[order][keep]
    dists[r[keep], place[keep]] = all_dist[order][keep]


def scan_list(own: np.ndarray, foreign: np.ndarray, k: int, floor: float | None, block: int = 24, epsilon: float = 2.1, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """k nearest of own points among own and foreign ones, and of foreign points among own ones: (indexes, squared distances).

    Indexes count the own points first; -1 fills up. ``floor``: similarity below which no neighbour is wanted. Pairs of
    two foreign points are left to their own lists. A pair is abandoned if its distance, estimated from the dimensions
    scanned so far, is above the larger of both points' k-th distance by more than the test allows.
    """
    m, n, dim = len(own), len(own) + len(foreign), own.shape[1] if len(own) else 0
    best = np.full((n, k), -1, np.int64), np.full((n, k), np.inf, np.float32)
    if not m:
        return best
    points = np.concatenate([own, foreign]) if len(foreign) else own
    top = np.float32(2.0 if floor is None else 2 - 2 * floor)
    top = top if floor is not None else np.float32(np.inf)
    cuts = list(range(block, dim, block)) + [dim]
    columns = [np.ascontiguousarray(points[:, a:b]) for a, b in zip([0, *cuts[:-1]], cuts)]  # one array a block of dimensions
    part = [np.einsum("ij,ij->i", c, c) for c in columns]
    for h0 in range(0, m, chunk):
        h1 = min(m, h0 + chunk)
        for q0 in range(h0, n, chunk):
            q1 = min(n, q0 + chunk)
            limit = np.minimum(top, np.maximum(best[1][q0:q1, -1][:, None], best[1][h0:h1, -1][None, :]))
            d = part[0][q0:q1, None] + part[0][None, h0:h1] - 2 * (columns[0][q0:q1] @ columns[0][h0:h1].T)
            alive = d * (dim / cuts[0]) <= limit * (1 + epsilon / math.sqrt(cuts[0])) ** 2 if cuts[0] < dim else d <= limit
            if q0 < h1:
                alive &= np.arange(q0, q1)[:, None] > np.arange(h0, h1)[None, :]
            i, j = np.nonzero(alive)
            dist = d[i, j]
            i, j = i + q0, j + h0
            for step in range(1, len(cuts)):
                b = cuts[step]
                if not len(i):
                    break
                dist = dist + part[step][i] + part[step][j] - 2 * np.einsum("ij,ij->i", columns[step][i], columns[step][j])
                bound = limit[i - q0, j - h0]
                keep = dist * (dim / b) <= bound * (1 + (epsilon / math.sqrt(b) if b < dim else 0)) ** 2
                i, j, dist = i[keep], j[keep], dist[keep]
            _merge(best, np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([dist, dist]).astype(np.float32), k)
    return best


def nearest(
    points: DataFrame, id_col: str, vector: str, dim: int, k: int = 5, min_similarity: float | None = None, delta: float = 0.15, probes: int = 8, block_rows: int = 8192
) -> DataFrame:
    """(id, neighbour, similarity): for every point its k most similar other points by cosine.

    Only vectors of ``dim`` finite elements that are not all zero take part; null or other vectors give and get no
    neighbours. Rows that repeat a point are one point, and points with equal vectors are different points of
    similarity 1. min_similarity leaves out neighbours below it, which also abandons candidates earlier. Points of equal similarity go by id.
    An empty table, or one with no valid vector, gives no rows.

    1.6 sqrt(n) lists are trained on SAMPLE_ROWS rows each (``list_centroids``); all rows are indexed. A point is copied,
    as 16-bit fixed-point numbers, to those of its ``probes`` closest lists whose centroid is within ``delta`` of the
    closest one's similarity. A pair is found if either point is copied to the other's list. Lists that the sample shows
    to have more than ``block_rows`` rows, or more than four times the mean where that is larger, are split by id, and
    every probe of such a list goes to each of its blocks; so the copies of a row do not grow with n, and the work grows
    as n to the power of 1.5. The centroids are broadcast: 4 * dim * 1.6 sqrt(n) bytes, 20 MB for a billion rows.
    Of rows with equal vectors only the k + 1 with the smallest ids are compared with anything (``apart``); the rest have
    those as neighbours, so that copies, however many, cost no pairs.
    """
    spark = points.sparkSession
    rows = points.select(F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector")).filter((F.size("vector") == dim) & F.col("id").isNotNull())
    stage = Stage(spark, "nearest")
    rows, extra = apart(stage, rows, k)
    n = max(1, rows.count())
    turn = rotation(dim)
    centroids, share = list_centroids(rows, n, dim, turn)
    if not len(centroids):
        return spark.createDataFrame([], f"{id_col} string, neighbour string, similarity double")
    n_blocks = list_blocks(share, n, block_rows)
    shared = spark.sparkContext.broadcast((turn.astype(np.float64), centroids, n_blocks))
    schema = "list int, block int, id string, own boolean, v binary"
    step = max(64, min(4096, (1 << 25) // len(centroids)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centroids, n_blocks = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                at, x = unit_rows(pa.concat_arrays([batch.column("vector")]), dim)
                names = np.array(batch.column("id").take(pa.array(at)).to_pylist(), dtype=object)
                if len(set(names)) < len(names):  # repeated rows are one point
                    once = list({(i, v.tobytes()): n for n, (i, v) in reversed(list(enumerate(zip(names, x))))}.values())
                    at, x, names = at[once], x[once], names[once]
                if not len(at):
                    continue
                exact = x.astype(np.float64) @ turn  # in double precision equal vectors get equal codes in every batch
                x = exact.astype(np.float32)
                near = x @ centroids.T
                width = min(probes, near.shape[1])
                order = np.argpartition(-near, width - 1, axis=1)[:, :width]
                score = np.take_along_axis(near, order, 1)
                rank = np.argsort(-score, axis=1, kind="stable")
                order, score = np.take_along_axis(order, rank, 1), np.take_along_axis(score, rank, 1)
                chosen = score >= score[:, :1] - delta
                who, col = np.nonzero(chosen)
                cell = order[who, col]
                home = batch.column("block").to_numpy()[at] % n_blocks[order[:, 0]]
                times = n_blocks[cell]
                who, cell, col = np.repeat(who, times), np.repeat(cell, times), np.repeat(col, times)
                block = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                own = (col == 0) & (block == home[who])
                codes = np.rint(exact * _SCALE).astype(np.int16)
                spare = ~_first_copies(codes, names, k)[1]
                sent = own | ~spare[who]  # of equal vectors only the first k + 1 are sent to other lists and blocks
                who, cell, block, own = who[sent], cell[sent], block[sent], own[sent]
                codes = codes[who]
                data = pa.py_buffer(np.ascontiguousarray(codes))
                offsets = pa.py_buffer((np.arange(len(who) + 1) * 2 * dim).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32)), batch.column("id").take(pa.array(at[who])), pa.array(own), pa.Array.from_buffers(pa.binary(), len(who), [None, offsets, data])],
                    names=["list", "block", "id", "own", "v"],
                )

    def scan(table: pa.Table) -> pa.Table:
        own = table.column("own").combine_chunks().to_numpy(zero_copy_only=False)
        ids = np.array(table.column("id").to_pylist(), dtype=object)
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), np.int16).reshape(-1, dim)
        order = np.lexsort((ids, ~own))
        ids, own, x = ids[order], own[order], x[order]
        once = np.r_[True, (ids[1:] != ids[:-1]) | (own[1:] != own[:-1])] if len(ids) else np.zeros(0, bool)
        ids, own, x = ids[once], own[once], np.ascontiguousarray(x[once])
        if not len(ids):
            return pa.table({"id": pa.array([], pa.string()), "neighbour": pa.array([], pa.string()), "similarity": pa.array([], pa.float32())})
        (order, starts, same), active = _first_copies(x, ids, k)
        extra = np.flatnonzero(~active & own)
        twins = order[starts[same[extra]][:, None] + np.arange(k)] if len(extra) else np.zeros((0, k), np.int64)
        more = ids[np.repeat(extra, k)], ids[twins.ravel()]
        ids, own, x = ids[active], own[active], x[active].astype(np.float32) / np.float32(_SCALE)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        m = int(own.sum())
        at, dist = scan_list(x[:m], x[m:], k, min_similarity)
        i, j = np.nonzero(at >= 0)
        return pa.table(
            {
                "id": pa.array(np.concatenate([ids[i], more[0]]), pa.string()),
                "neighbour": pa.array(np.concatenate([ids[at[i, j]], more[1]]), pa.string()),
                "similarity": pa.array(np.concatenate([1 - dist[i, j] / 2, np.ones(len(more[0]), np.float32)]), pa.float32()),
            }
        )

    copies = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("int")).mapInArrow(index, schema)
    found = copies.groupBy("list", "block").applyInArrow(scan, "id string, neighbour string, similarity float").filter("id <> neighbour")
    each = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("d"), F.col("neighbour").alias("n")))).alias("c"))
    names = F.transform("c", lambda x: x["n"])
    kept = F.slice(F.filter("c", lambda x, i: F.array_position(names, x["n"]) == i + 1), 1, k)
    out = each.select(F.col("id").alias(id_col), F.explode(kept).alias("x"))
    out = out.select(id_col, F.col("x.n").alias("neighbour"), (-F.col("x.d")).cast("double").alias("similarity"))
    return out if extra is None else out.unionByName(extra.withColumnRenamed("id", id_col))


def neighbour_pairs(found: DataFrame, id_col: str, min_similarity: float) -> DataFrame:
    """(id_a, id_b), distinct, smaller first: pairs in which one is among the other's neighbours at this similarity or more."""
    return found.filter(F.col("similarity") >= min_similarity).select(F.least(id_col, "neighbour").alias("id_a"), F.greatest(id_col, "neighbour").alias("id_b")).distinct()


def brute_force(x: np.ndarray, k: int) -> np.ndarray:
    """Exact neighbours of all rows, for recall measurements."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def recall(found: pd.DataFrame, id_col: str, ids: list[str], exact: np.ndarray, kept: np.ndarray) -> float:
    """Share of the exact (row, neighbour) pairs that were found, counting those where ``kept`` is true."""
    got = set(zip(found[id_col], found["neighbour"]))
    i, j = np.nonzero(kept)
    return float(np.mean([(ids[a], ids[exact[a, b]]) in got for a, b in zip(i, j)])) if len(i) else 1.0
