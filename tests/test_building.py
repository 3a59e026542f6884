"""Page clean-up, snippets, judged lists, ingest and retrieval pieces against plain Python and fixed cases."""

import re

import pytest
from pyspark.sql import functions as F

from phloem.functions import text as t
from phloem.operators import docs, extract, graph, rank, vector
from phloem.plans import ingest, judge, keywords, profiles, retrieve


def test_pages_are_cleaned_step_by_step(spark):
    page = "\n".join(["Mục lục", "Viêm da", "01/02/2024", "# Viêm da", "", "Viêm da là gì?", "Bệnh hay gặp.", "", "1. Thể nhẹ", "- [x](https://a.example/x)", "[chỉ liên kết](https://a.example/y)", "Xem thêm: bài khác", "# Viêm da", "Hết bài.", "Nguồn tham khảo", "[1] sách"])
    rows = spark.createDataFrame([(1, page, "Viêm da", "k"), (2, None, "t", "k"), (3, "", None, "k")], "id int, markdown string, title string, __x string")
    got = {r.id: r.markdown for r in docs.clean_pages(rows).collect()}
    assert got[1] == "# Viêm da\n\n## Viêm da là gì?\nBệnh hay gặp.\n\n### 1. Thể nhẹ\n- [x](https://a.example/x)\nHết bài."
    assert got[2] is None and got[3] == ""
    assert docs.clean_pages(rows.limit(0)).count() == 0


def test_snippets_and_judged_lists(spark):
    row = spark.createDataFrame([("a " * 50 + "GỌI LÀ x " + "b " * 50, '{"verdicts": [{"statement": "s", "supported": "Có"}, {"supported": false}, {"supported": true}]}', '```json {"statements": [" một ", "", null, "hai"]}```', "không phải JSON")], "t string, v string, s string, bad string")
    got = row.select(judge.snippets(F.col("t"), ("gọi là", "mất"), 10).alias("n"), judge.supported("v").alias("v"), judge.said_texts("s", "statements").alias("s"), judge.said_texts("bad", "statements").alias("bad")).collect()[0]
    assert len(got.n) == 1 and "GỌI LÀ" in got.n[0]
    assert got.v == [True, False, True] and got.s == ["một", "hai"] and got.bad == []


def test_judged_edges(spark):
    schema = "statements array<string>, support array<boolean>, question_vector array<double>, generated_vectors array<array<double>>, context string, relevant array<string>, safety string, correctness string, reference string"
    rows = spark.createDataFrame(
        [(["a", "b"], [True], [1.0, 0.0], [[1.0, 0.0], [-1.0, 0.0]], "Một câu. Hai câu.", ["Một câu."], "0.9", "4", "r"), (None, None, None, None, None, None, None, None, None), (["a"], [True, True], [0.0], [[0.0]], "x", ["Insufficient Information"], "n/a", "1", " ")], schema
    )
    got = [r.asDict() for r in judge.judged(rows).collect()]
    assert (got[0]["faithfulness"], got[0]["answer_relevance"], got[0]["context_relevance"], got[0]["answer_correctness"]) == (0.5, 0.5, 0.5, 0.8)
    assert got[1]["overall"] == 0 and got[1]["verdict"] == "fail"
    assert got[2]["faithfulness"] == 1 and got[2]["context_relevance"] == 0 and got[2]["answer_correctness"] == 0


def test_low_keywords_of_questions(spark):
    asked = spark.createDataFrame([("viêm da cơ địa có triệu chứng gì",), ("có gì",), ("Hắt hơi và sổ mũi",), ("",), (None,)], "q string")
    got = [r.k for r in asked.select(keywords.low_keywords(F.col("q")).alias("k")).collect()]
    assert got[0] == ["viêm da cơ địa"] and got[1] == ["có gì"] and got[2] == ["hắt hơi", "sổ mũi"]
    assert keywords.understood(asked.withColumnRenamed("q", "text")).count() == 5


def _ranks(seeds, edges, damping=0.85, rounds=100, tolerance=1e-7):
    out = {}
    for s, t, w in edges:
        out.setdefault(s, {}).setdefault(t, 0.0)
        out[s][t] += w
        out.setdefault(t, {}).setdefault(s, 0.0)
        out[t][s] += w
    nodes, total = set(seeds) | set(out), sum(seeds.values())
    p = {n: seeds.get(n, 0) / total for n in nodes}
    rank_ = dict(p)
    for _ in range(rounds):
        sunk = sum(r for n, r in rank_.items() if n not in out)
        new = {n: (1 - damping) * p[n] + damping * sunk * p[n] for n in nodes}
        for s, ts in out.items():
            for t, w in ts.items():
                new[t] += damping * rank_[s] * w / sum(ts.values())
        moved = sum(abs(new[n] - rank_[n]) for n in nodes)
        rank_ = new
        if moved <= tolerance:
            break
    return rank_


def test_pagerank_of_a_query_does_not_depend_on_its_batch(spark):
    first = ({"a": 1.0, "b": 2.0}, [("a", "c", 1.0), ("c", "d", 0.5), ("d", "b", 2.0), ("d", "e", 1.0)])
    second = ({"x": 1.0}, [])
    seeds = spark.createDataFrame([("q1", k, v) for k, v in first[0].items()] + [("q2", "x", 1.0)], "query_id string, entity_id string, score double")
    edges = spark.createDataFrame([("q1", *e) for e in first[1]], "query_id string, source string, target string, weight double")
    got = {(r.query_id, r.entity_id): r.score for r in rank.pagerank(seeds, edges, iterations=60, tolerance=1e-4).collect()}
    want = {("q1", n): r for n, r in _ranks(*first, rounds=60, tolerance=1e-4).items()} | {("q2", "x"): 1.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_many_queries_are_joined_as_a_grid(spark, monkeypatch):
    points = spark.range(300).selectExpr("cast(id as string) point_id", "array(cast(id % 17 as double), cast(id % 5 as double) + 1) vector")
    queries = spark.range(40).selectExpr("id query_id", "array(cast(id % 7 as double), 1.0D) vector")
    want = {tuple(r) for r in vector.topk(queries, points, 4).collect()}
    monkeypatch.setattr(vector, "MAX_QUERIES", 10)
    assert {tuple(r) for r in vector.topk(queries, points, 4, block=8).collect()} == want
    monkeypatch.setattr(graph, "MAX_QUESTIONS", 2)
    with pytest.raises(ValueError):
        graph.lexical_scores(spark.createDataFrame([(str(i), "x") for i in range(3)], "query_id string, text string"), points, {"point_id": 1}, "point_id")


def test_ingest_of_small_records(spark):
    entity = lambda n, k: (n, k, "", "e")
    relation = ("Viêm da", "BENH_LY", "CO_BIEU_HIEN", "ngứa", "BIEU_HIEN_LAM_SANG", None, [], "Viêm da gây ngứa.", 0.7)
    bad = ("Viêm da", "BENH_LY", "CO_BIEU_HIEN", "bác sĩ", "BENH_LY", None, [], "x", 0.5)
    records = spark.createDataFrame(
        [("c1", True, [entity("viêm da", "BENH_LY"), entity("VIÊM DA", "BENH_LY"), entity("bệnh viện A", "BENH_LY")], [relation, bad, relation]), ("c2", True, [], [relation]), ("c3", False, None, None), ("gone", True, [entity("x y", "BENH_LY")], [])],
        f"chunk_id string, ok boolean, entities array<{ingest.ENTITY}>, relations array<{ingest.RELATION}>",
    )
    chunks = spark.createDataFrame([(f"c{i}", "a1", "s", "u", "text", None) for i in (1, 2, 3, 4)], "chunk_id string, article_id string, section string, source_url string, text string, contextualized_text string")
    w = ingest.write_graph(records, chunks)
    entities = {r.normalized_name: r for r in w.entities.collect()}
    assert set(entities) == {"viem da", "ngua"} and entities["viem da"].mention_count == 2 and entities["viem da"].name == "viêm da"
    found = w.relations.collect()
    assert len(found) == 1 and found[0].evidence_chunk_ids == ["c1", "c2"] and found[0].confidence == 0.7 and "triệu chứng" in found[0].keywords
    assert w.mentions.count() == 4
    stats = ingest.article_stats(w.chunk_stats, chunks).collect()[0]
    assert (stats.chunks, stats.failed_chunks, stats.raw_entities, stats.raw_relations, stats.without_keywords) == (4, 2, 3, 4, 4)
    assert {r.kind for r in ingest.vector_points(w, chunks).collect()} == {"chunk", "entity", "relation"}
    assert ingest.write_graph(records.limit(0), chunks).entities.count() == 0


def test_texts_of_profiles_are_folded_once(spark):
    rows = spark.createDataFrame([("CO_BIEU_HIEN", "Viêm da", "ngứa", None, "Ho khan, ngứa " * 3)], "relation_type string, subject_name string, object_name string, description string, evidence_text string")
    made = rows.select(profiles.relation_keywords().alias("k"))
    assert made.collect()[0].k == ["Viêm da", "ngứa", "triệu chứng", "biểu hiện lâm sàng", "gợi ý bệnh từ triệu chứng", "triệu chứng hô hấp", "bệnh hô hấp", "triệu chứng da"]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("evidence_text#") <= 2  # where it is read, and in one expression


def test_look_ups_agree_with_patterns(spark):
    odd = ["", " ", "a", None, " a  b ", "**Viêm__ da** .", "* *a* *", "(x) - y:", "a\t\nb\x0b\fc\rd", "Đau ‘họng’ “x” đ", "e\u0301 ho\u0323 ", "_a_ 'b' \"c\" `d`", "--__--", "日本 a 語", "a ** b", "\u00a0x\u00a0", "–A—", "[doi_tuong]", "BÁC  SĨ", "ts.bs. A"]
    rows = spark.createDataFrame([(x,) for x in odd], "x string")
    pairs = (
        (t.spaced("x"), t.collapse("x")), (t.shown("x"), t.display_name("x")), (t.folded("x"), t.fold("x")), (t.unmarked("x"), t.collapse(t.strip_marks(F.col("x")))), (t.shown(t.shown("x")), t.display_name(t.display_name("x"))),
        (t.name_id(t.folded("x"), F.lit("K")), t.entity_id("x", F.lit("K"))), (t.holds_any(t.folded("x"), extract.BLOCKED), t.contains_any(F.lower(F.trim("x")), extract.BLOCKED) | t.contains_any(t.fold("x"), extract.BLOCKED)),
    )
    for i, (a, b) in enumerate(pairs):
        assert [] == [(i, *r) for r in rows.select("x", a.alias("a"), b.alias("b")).collect() if r.a != r.b]


def test_proposed_keys_need_support(spark):
    rows = spark.createDataFrame([("e", "viêm da", "BENH_LY", "Viêm da hay eczema", ["viêm da"], ["eczema", "xét nghiệm"], ["bệnh da", "viêm da", "thể viêm da"])], "entity_id string, name string, entity_type string, description string, surface_forms array<string>, l array<string>, g array<string>")
    got = profiles.proposed_keys(profiles.entity_profiles(rows), "l", "g").collect()[0]
    assert got.local_keys == ["viêm da", "eczema"] and got.global_keys == ["bệnh da"]


def test_boost_by_names_and_evidence(spark):
    entities = spark.createDataFrame([("d1", "Viêm da", "BENH_LY", 1), ("s1", "ngứa", "BIEU_HIEN_LAM_SANG", 1)], "entity_id string, name string, entity_type string, mention_count int")
    relations = spark.createDataFrame([("r1", "d1", "s1", "CO_BIEU_HIEN", 0.9)], "relation_id string, subject_entity_id string, object_entity_id string, relation_type string, confidence double")
    links = spark.createDataFrame([("r1", "c1")], "relation_id string, chunk_id string")
    chunks = spark.createDataFrame([("c1", "t", None, "không tên"), ("c2", "Về VIÊM DA", "s", "x" * 2000), ("c3", None, None, "y" * 900 + " viêm da")], "chunk_id string, title string, section string, text string")
    x = retrieve.Tables(entities, relations, links, None, chunks)
    hits = spark.createDataFrame([("q", c, 1.0) for c in ("c1", "c2", "c3")], "query_id string, chunk_id string, score double")
    got = {r.chunk_id: round(r.score, 9) for r in retrieve.boosted(x, hits, spark.createDataFrame([("q", "r1", 0.5)], "query_id string, relation_id string, score double"), spark.createDataFrame([("q", "d1", 2.0)], "query_id string, entity_id string, score double")).collect()}
    assert got == {"c1": 3.0, "c2": 1.7, "c3": 1.0}


def test_sentences_of_a_context(spark):
    text = "[Context 1] | chunk_id=a\n## Mục\nMột câu. Hai câu! - ba\n\nbốn"
    got = spark.createDataFrame([(text,)], "t string").select(judge.context_sentences(F.col("t")).alias("s")).collect()[0].s
    assert got == [x for x in re.split(r"(?<=[.!?])\s+|\s+-\s+", "Một câu. Hai câu! - ba bốn") if x]
