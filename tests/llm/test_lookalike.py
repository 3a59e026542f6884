import unicodedata

from phloem.llm.lookalike import alike_pairs, folded

BASE = ["viêm da cơ địa", "hội chứng ống tai", "đau đầu", "Đợt ho khan", "β3 xuruluge", "kháng thể TEB-15", "m² da", "cop sao"]


def _pairs(spark, rows, fields=("name", "aliases")):
    df = spark.createDataFrame(rows, "eid string, name string, aliases array<string>, id string")
    return {tuple(r) for r in alike_pairs(df, "eid", list(fields)).collect()}


def test_kinds_of_likeness(spark):
    a = [(f"a{i}", n, [], "x") for i, n in enumerate(BASE)]
    b = [
        ("b0", unicodedata.normalize("NFD", "viêm da cơ địa"), None, "x"), ("b1", "hội chứng ống​ tai", [], "x"), ("b2", "đаu đầu", [], "x"), ("b3", "Ðợt ho khan", [], "x"),
        ("b4", "b3 xuruluge", [], "x"), ("b5", "ｋháng thể TEB‑15", [], "x"), ("b6", "m2 da", [], "x"), ("b7", "сор sао", [], "x"), ("b8", "Đau đầu", [], "x"), ("b9", "dau dau", [], "x"), ("b8", "Đau đầu", [], "x"),
    ]
    assert _pairs(spark, a + b) == {("name", f"a{i}", f"b{i}") for i in (0, 1, 2, 3, 5, 7)}


def test_fields_do_not_mix_and_nulls(spark):
    rows = [("a", "ho khan", ["sốt", None, "​"], "x"), ("b", "sốt​", ["ho khan", ""], "x"), ("c", None, ["sốt­", "sốt"], "x"), (None, "ho khan", [], "x")]
    assert _pairs(spark, rows) == {("aliases", "a", "c")}
    assert _pairs(spark, []) == set()


def test_folding_keeps_real_differences():
    assert folded("x²") != folded("x2") and folded("β") != folded("b") and folded("A") != folded("a")
    assert folded("ｘ－１　") == "x-1 "


def test_classes_link_what_pairs_link_and_a_hot_spelling_is_split(spark, monkeypatch):
    import phloem.llm.lookalike as module

    monkeypatch.setattr(module, "_HOLDERS", 7)
    rows = [(f"h{i:03d}", "ho khan", ["sốt"], "x") for i in range(60)] * 2 + [("z1", "hо khan", [], "x"), ("z2", "hо khan", [], "x"), ("z3", "ho​ khan", None, "x")]
    want = {("name", f"h{i:03d}", z) for i in range(60) for z in ("z1", "z2", "z3")} | {("name", "z1", "z3"), ("name", "z2", "z3")}
    assert _pairs(spark, rows) == want
    df = spark.createDataFrame(rows, "eid string, name string, aliases array<string>, id string")
    got = [tuple(r) for r in module.alike_classes(df, "eid", ["name", "aliases"]).collect()]
    assert len(got) == 63 and {r[1] for r in got} == {"ho khan"} and len({r[2] for r in got}) == 3
