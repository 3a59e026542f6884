import datetime as dt
import json

from phloem.sources import readers, writers
from phloem.streaming import ingest
from pyspark.sql import functions as F


def test_markdown_round_trip(spark, tmp_path):
    row = ("s", "https://a.example/x", 'Tên "hay"', None, "2024-01-02", ["https://a.example/y"], "chữ\n\n## Mục\nthêm")
    df = spark.createDataFrame([row], "source string, url string, title string, author string, published_at string, related_links array<string>, body string")
    full = df.withColumns({c: F.lit(None).cast("string") for c in ("description", "updated_at", "category", "crawled_at")})
    text = writers.markdown_text(full).first()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / text.file_name).write_text(text.value)
    (tmp_path / "in" / "plain.md").write_text("# Trần\n\nchữ trần")
    got = {r.title: r for r in readers.markdown_articles(spark, str(tmp_path / "in")).collect()}
    a = got['Tên "hay"']
    assert a.related_links == ["https://a.example/y"] and a.published_at == "2024-01-02" and a.author is None
    assert a.body == '# Tên "hay"\n\nchữ\n\n## Mục\nthêm' and a.article_id.startswith("article_")
    assert got["Trần"].url is None


def test_lists_and_questions(spark, tmp_path):
    (tmp_path / "u.json").write_text(json.dumps({"selected_urls": ["a", "b", "a"]}))
    (tmp_path / "u.txt").write_text("# c\na\n\n b \n")
    (tmp_path / "l.json").write_text('["z"]')
    assert {r.url for r in readers.url_list(spark, str(tmp_path / "u.json")).collect()} == {"a", "b"}
    assert {r.url for r in readers.url_list(spark, str(tmp_path / "u.txt")).collect()} == {"a", "b"}
    assert {r.url for r in readers.url_list(spark, str(tmp_path / "l.json")).collect()} == {"z"}
    (tmp_path / "q.json").write_text(json.dumps({"items": [{"question": "x?", "expected_answer": "y", "expected_entities": ["e"]}, {"reference": "no"}]}))
    rows = readers.questions(spark, str(tmp_path / "q.json")).collect()
    assert [(r.question, r.reference, r.expected_terms) for r in rows] == [("x?", "y", ["e"])]


def test_extractions_and_lenient_json(spark, tmp_path):
    writers.append_json(spark.createDataFrame([("c", True)], "chunk_id string, ok boolean"), str(tmp_path / "x"))
    writers.append_json(spark.createDataFrame([("d", False)], "chunk_id string, ok boolean"), str(tmp_path / "x"))
    assert readers.extractions(spark, str(tmp_path / "x")).count() == 2
    got = spark.createDataFrame([('so: {"a": 1} done',), ("none",)], "t string").select(readers.lenient_json("t", "a int")["a"].alias("a")).collect()
    assert [r.a for r in got] == [1, None]


def test_hash_embeddings_are_unit_and_stable(spark):
    df = spark.createDataFrame([("viêm da",), ("viêm da",), (None,)], "t string")
    v = [r.vector for r in readers.hash_embeddings(df, "t", 16).collect()]
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-6 and sum(map(abs, v[2])) == 0


def test_stream_is_resumable(spark, tmp_path):
    def put(n, body):
        spark.createDataFrame([("a", body, dt.datetime(2024, 1, n))], "article_id string, body string, ingested_at timestamp").write.mode("append").parquet(str(tmp_path / "in"))

    put(1, "old")
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for n, body in ((2, "new"), (3, "newest")):
        ingest.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), schema).awaitTermination(60)
        put(n, body)
    ingest.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), schema).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert ingest.current(spark, str(tmp_path / "out")).first().body == "newest"
