import math

import numpy as np

from phloem.llm.knn import brute_force, nearest, neighbour_pairs, recall, scan_list


def _clusters(n=1200, dim=32, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((n // 12, dim))
    x = np.repeat(c, 12, axis=0) + 0.35 * rng.standard_normal((n // 12 * 12, dim))
    return (x * rng.uniform(0.1, 9, (len(x), 1))).astype(np.float32)


def test_scan_without_pruning_is_exact():
    x = _clusters(240)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at, _ = scan_list(x, x[:0], 5, None, block=8, epsilon=50.0, chunk=64)
    exact = brute_force(x, 5)
    assert all(set(a) == set(b) for a, b in zip(at, exact))


def test_recall_and_pairs(spark):
    x = _clusters()
    ids = [f"p{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), "c") for i, v in zip(ids, x)], "pid string, vec array<float>, id string")
    found = nearest(df, "pid", "vec", 32, 5, block_rows=200).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = brute_force(u, 5)
    assert recall(found, "pid", ids, exact, np.ones_like(exact, bool)) >= 0.9
    assert found.groupby("pid").size().max() == 5 and (found.pid != found.neighbour).all()
    some = found.sample(50, random_state=1)
    for r in some.itertuples():
        assert math.isclose(r.similarity, float(u[ids.index(r.pid)] @ u[ids.index(r.neighbour)]), abs_tol=1e-3)


def test_dirty_vectors_repeats_and_ties(spark):
    good = [1.0] + [0.0] * 7
    rows = [("a", good), ("a", good), ("b", [2.0] + [0.0] * 7), ("c", None), ("d", []), ("e", [1.0]), ("f", [0.0] * 8), ("g", [float("nan")] * 8), ("h", [None] + [1.0] * 7), ("i", [0.0, 1.0] + [0.0] * 6), (None, good)]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    found = nearest(df, "id", "v", 8, 5, 0.5)
    assert {(r.id, r.neighbour) for r in found.collect()} == {("a", "b"), ("b", "a")}
    assert [tuple(r) for r in neighbour_pairs(found, "id", 0.75).collect()] == [("a", "b")]
    assert nearest(df.limit(0), "id", "v", 8).count() == 0
    assert nearest(df.filter("id in ('c', 'f')"), "id", "v", 8).count() == 0


def test_many_copies_of_one_vector(spark):
    x = _clusters(240, 8)
    rows = [(f"c{i:04d}", [1.0] * 8) for i in range(900)] + [(f"p{i:04d}", v.tolist()) for i, v in enumerate(x)]
    rows += [("c0000", [1.0] * 8)] * 20
    found = nearest(spark.createDataFrame(rows, "id string, v array<float>"), "id", "v", 8, 5, None, block_rows=100).toPandas()
    copies = found[found.id.str.startswith("c")]
    assert copies.groupby("id").size().eq(5).all() and copies.id.nunique() == 900 and (copies.similarity > 1 - 1e-6).all()
    smallest = {f"c{i:04d}" for i in range(6)}
    assert set(copies.neighbour) == smallest and (copies.id != copies.neighbour).all()
    others = found[found.id.str.startswith("p")]
    assert others.groupby("id").size().eq(5).all()


def test_copies_are_taken_apart_over_the_whole_collection(spark):
    from phloem.llm.knn import apart
    from phloem.storage import Stage

    rows = [(f"c{i:04d}", [1.0] * 8) for i in range(300)] + [(f"z{i}", [0.0] * 8) for i in range(20)] + [(f"p{i}", [float(i)] * 8) for i in range(2, 5)] + [("c0299", [1.0] * 8)]
    df = spark.createDataFrame(rows, "id string, vector array<float>").repartition(7)
    left, extra = apart(Stage(spark, "t"), df, 5)
    assert {r.id for r in left.collect()} == {f"c{i:04d}" for i in range(6)} | {f"z{i}" for i in range(20)} | {f"p{i}" for i in range(2, 5)}
    got = extra.toPandas()
    assert len(got) == 294 * 5 and set(got.neighbour) == {f"c{i:04d}" for i in range(5)}


def test_lists_and_blocks_at_growing_sizes(spark):
    from phloem.llm.knn import list_blocks, list_centroids, rotation

    for n in (3000, 30000):
        x = _clusters(n)
        df = spark.createDataFrame([(f"p{i:06d}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<float>")
        c, share = list_centroids(df, len(x), 32, rotation(32))
        assert 0.5 < len(c) / (1.6 * math.sqrt(len(x))) < 2 and math.isclose(share.sum(), 1)
    rng = np.random.default_rng(4)
    for n in (10**5, 10**7, 10**9, 10**10):
        share = rng.pareto(1.1, math.ceil(1.6 * math.sqrt(n)))
        blocks = list_blocks(share / share.sum(), n, 8192)
        assert blocks.sum() <= 1.25 * len(blocks) + 1 and (share / share.sum() * n / blocks).max() <= max(8192, 4 * n / len(blocks))
