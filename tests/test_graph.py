import math

from phloem.operators import rank as r
from phloem.operators import vector
from pyspark.sql import functions as F


def test_pagerank_against_plain_loop(spark):
    edges = [("q", "a", "b", 1.0), ("q", "b", "c", 0.5), ("q", "a", "a", 0.2), ("q", "c", "a", None), ("q", "d", "a", 0.0)]
    seeds = [("q", "a", 2.0), ("q", "z", 1.0), ("r", "b", 1.0)]
    got = {(x.query_id, x.entity_id): x.score for x in r.pagerank(spark.createDataFrame(seeds, "query_id string, entity_id string, score double"), spark.createDataFrame(edges, "query_id string, source string, target string, weight double"), iterations=60).collect()}
    out: dict = {}
    for _, s, t, w in edges:
        w = 1.0 if w is None else w
        if w > 0:
            for x, y in ((s, t), (t, s)):
                out.setdefault(x, {}).setdefault(y, 0.0)
                out[x][y] += w
    p = {"a": 2 / 3, "z": 1 / 3}
    rank = dict(p)
    for _ in range(60):
        nxt = {n: 0.15 * p.get(n, 0) for n in {*out, *p}}
        sink = sum(v for n, v in rank.items() if n not in out)
        for s, targets in out.items():
            for t, w in targets.items():
                nxt[t] += 0.85 * rank.get(s, 0) * w / sum(targets.values())
        for n, v in p.items():
            nxt[n] += 0.85 * sink * v
        rank = nxt
    for n, v in rank.items():
        assert math.isclose(got[("q", n)], v, abs_tol=1e-6)
    assert math.isclose(sum(v for (q, _), v in got.items() if q == "q"), 1, abs_tol=1e-9)
    assert math.isclose(got[("r", "b")], 1, abs_tol=1e-9)


def test_fusion_does_not_depend_on_branch_order(spark):
    rows = [("q", "c1", 0.9, "a"), ("q", "c2", 0.8, "a"), ("q", "c2", 5.0, "b"), ("q", "c3", None, "b")]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, score double, branch string")
    one = {x.chunk_id: round(x.score, 9) for x in r.reciprocal_rank_fusion(df, "chunk_id").collect()}
    two = {x.chunk_id: round(x.score, 9) for x in r.reciprocal_rank_fusion(df.orderBy(F.desc("branch")), "chunk_id").collect()}
    assert one == two and one["c2"] == round(1 / 62 + 1 / 61, 9)


def test_vector_topk_edge_cases(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "point_id int, vector array<double>")
    queries = spark.createDataFrame([(7, [2.0, 0.0]), (8, None), (9, [])], "query_id int, vector array<double>")
    got = [(x.query_id, x.point_id, x.score, x.rank) for x in vector.topk(queries, points, 3).orderBy("query_id", "rank").collect()]
    assert got == [(7, 1, 1.0, 1), (7, 2, 1.0, 2), (7, 3, 0.0, 3)]
    assert vector.topk(queries, points.limit(0), 3).count() == 0 and vector.topk(queries.limit(0), points, 3).count() == 0
