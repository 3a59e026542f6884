import random

from phloem.llm.groups import connected_groups


def _plain(edges):
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent}


def _run(spark, edges):
    df = spark.createDataFrame([(*e, "x") for e in edges], "a string, b string, node string")
    return {r.node: r.group_id for r in connected_groups(df, "a", "b").collect()}


def test_chain_star_random_nulls_and_repeats(spark):
    rnd = random.Random(3)
    ids = [f"e{i:03d}" for i in range(60)]
    shuffled = rnd.sample(ids, 40)
    chain = list(zip(shuffled, shuffled[1:]))
    star = [("z9", f"s{i}") for i in range(30)]
    noise = [("n1", None), (None, "n2"), ("self", "self"), chain[0], (chain[1][1], chain[1][0])]
    edges = chain + star + noise + [("m1", "m2"), ("m3", "m4"), ("m2", "m3")]
    assert _run(spark, edges) == _plain(edges)


def test_empty(spark):
    assert _run(spark, []) == {}
    assert _run(spark, [("a", "a"), (None, None)]) == {}
