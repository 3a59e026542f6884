import random
from collections import Counter, defaultdict

from phloem.llm.mixing import mix
from phloem.llm.packing import best_fit, fill_report, pack
from phloem.llm.tokens import encoder, with_tokens


def _pack(spark, sizes, caps):
    s = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc string, tokens long, spec_id string") if False else spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc int, tokens long, bin string")
    specs = spark.createDataFrame([(i, c) for i, c in enumerate(caps)], "spec_id int, capacity_tokens int")
    return pack(s, specs, "doc"), specs


def test_every_item_once_and_within_capacity(spark):
    sizes = [(i * 37) % 97 + 1 for i in range(400)] + [250, 100, 1, 1, 1, 0, None]
    packed, specs = _pack(spark, sizes, [100, 1000])
    rows = packed.collect()
    for spec, cap in ((0, 100), (1, 1000)):
        own, load = defaultdict(int), defaultdict(int)
        for r in rows:
            if r.spec_id == spec:
                own[r.doc] += r.tokens
                load[r.container_id] += r.tokens
                assert r.tokens <= cap and r.first_token == r.piece * cap
        assert dict(own) == {i: n for i, n in enumerate(sizes) if n}
        assert max(load.values()) <= cap
        split = {r.doc for r in rows if r.spec_id == spec and r.piece > 0}
        assert split == {i for i, n in enumerate(sizes) if n and n > cap}
    used = {r.spec_id: r.used for r in fill_report(packed, specs).collect()}
    assert used[0] > 0.93 and used[1] > 0.95


def test_pack_edges(spark):
    assert _pack(spark, [], [10])[0].count() == 0
    assert _pack(spark, [5], [])[0].count() == 0
    assert _pack(spark, [None, 0], [10])[0].count() == 0
    assert _pack(spark, [10] * 40, [10])[0].select("container_id").distinct().count() == 40


def _item_by_item(sizes, capacity):
    gaps = []
    for size in sorted(sizes, reverse=True):
        fitting = [g for g in gaps if g >= size]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - size)
        else:
            gaps.append(capacity - size)
    return sorted(gaps)


def test_classes_are_packed_as_items_are():
    rnd = random.Random(5)
    for capacity in (7, 30, 100):
        for n in (1, 20, 300):
            sizes = [min(capacity, 1 + int(rnd.expovariate(3 / capacity))) for _ in range(n)] + [capacity // 3] * (n // 2)
            loads = defaultdict(int)
            placed = defaultdict(int)
            for size, rank, first, containers, each in best_fit(list(Counter(sizes).items()), capacity):
                assert rank == placed[size]
                placed[size] += containers * each
                for c in range(first, first + containers):
                    loads[c] += size * each
            assert placed == Counter(sizes)
            assert sorted(capacity - x for x in loads.values()) == _item_by_item(sizes, capacity)


def test_a_class_over_many_partitions(spark, monkeypatch):
    import phloem.llm.packing as module

    monkeypatch.setattr(module, "_PART_ROWS", 50)
    packed, _ = _pack(spark, [30] * 500 + [41] * 77 + [100] * 3, [100])
    rows = packed.collect()
    loads = defaultdict(int)
    for r in rows:
        loads[r.container_id] += r.tokens
    assert len(rows) == 580 == len({(r.doc, r.piece) for r in rows})
    assert sorted(100 - x for x in loads.values()) == _item_by_item([30] * 500 + [41] * 77 + [100] * 3, 100)


def test_repeated_ids_are_items_of_their_own(spark):
    s = spark.createDataFrame([("a", 5)] * 9 + [(None, 5), ("a", 25)], "doc string, tokens int")
    packed = pack(s, spark.createDataFrame([(1, 10)], "spec_id int, capacity_tokens int"), "doc")
    rows = packed.collect()
    assert sum(r.tokens for r in rows) == 75 and len(rows) == 13 and sum(r.doc is None for r in rows) == 1


def test_mix_shares_caps_and_report(spark):
    docs = [(f"{s}{i}", s, 10 + i % 7, "z") for s, n in (("big", 600), ("small", 20), ("mid", 200)) for i in range(n)] + [("none", None, 10, "z"), ("zero", "big", 0, "z"), ("other", "unlisted", 50, "z"), ("nul", "big", None, "z")]
    df = spark.createDataFrame(docs, "doc string, source string, tokens int, copies string").drop("copies")
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.4, 4), ("mid", 0.2, 3), ("gone", 0.1, 2), (None, 0.5, 1), ("mid", None, None)], "source string, target_share double, max_repeats int")
    chosen, report = mix(df, targets, "doc")
    rows, rep = chosen.collect(), {r.source: r for r in report.collect()}
    assert len({r.doc for r in rows}) == len(rows) and set(rep) == {"big", "small", "mid", "gone"}
    caps = {"big": 1, "small": 4, "mid": 3}
    total = sum(r.tokens * r.copies for r in rows)
    for s, cap in caps.items():
        own = [r for r in rows if r.source == s]
        assert all(1 <= r.copies <= cap for r in own)
        reached = sum(r.tokens * r.copies for r in own)
        assert reached == rep[s].reached and abs(reached / total - rep[s].reached_share) < 1e-9
        assert abs(reached - rep[s].budget) <= 8
    assert rep["small"].capped and rep["gone"].reached == 0 and not rep["big"].capped
    assert abs(rep["big"].share_of_total - 0.3) < 0.01 and abs(rep["mid"].share_of_total - 0.2) < 0.01
    assert sorted(map(tuple, mix(df, targets, "doc")[0].collect())) == sorted(map(tuple, rows))
    assert mix(df.limit(0), targets, "doc")[0].count() == 0 and mix(df, targets.limit(0), "doc")[0].count() == 0


def test_inclusion_is_in_proportion_to_weight(spark):
    """Over many seeds, records are taken as often as min(1, scale * weight) says; certain ones always."""
    weights = [1.0] * 60 + [4.0] * 30 + [100.0] * 3 + [0.0, None, float("nan")]
    df = spark.createDataFrame([(f"d{i}", "s", 10, w) for i, w in enumerate(weights)], "doc string, source string, tokens int, w double").coalesce(1)
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    taken = Counter()
    rounds = 10
    for seed in range(rounds):
        rows = mix(df, targets, "doc", total=390, seed=seed, weight="w")[0].collect()
        assert sum(r.tokens * r.copies for r in rows) == 390
        taken.update(int(r.doc[1:]) for r in rows)
    scale = 36 / (60 + 120)  # 3 of 39 records are certain, the others share 36
    light, heavy = sum(taken[i] for i in range(60)) / 60 / rounds, sum(taken[i] for i in range(60, 90)) / 30 / rounds
    assert all(taken[i] == rounds for i in (90, 91, 92)) and not any(taken[i] for i in (93, 94, 95))
    assert abs(light - scale) < 0.06 and abs(heavy - 4 * scale) < 0.1


def test_token_sizes(spark):
    texts = ["", None, "Viêm da <|endoftext|> cơ địa", "a" * 100_000]
    got = [r.n for r in with_tokens(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string"), "t", "n").orderBy("i").collect()]
    e = encoder()
    assert got == [len(e.encode_ordinary(x or "")) for x in texts]
    assert e.decode(e.encode_ordinary(texts[2])) == texts[2]
