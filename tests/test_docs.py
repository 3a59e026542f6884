import uuid

from phloem.functions import text as t
from phloem.operators import docs
from phloem.plans import keywords
from pyspark.sql import functions as F

BODY = "mở đầu\n\n# Tên bài\n\n## Một\nchữ một\n\n### Con\nchữ con\n\n# Khác\nchữ khác\n\n### Sau\nchữ sau\n## Rỗng\n\n## Hai\nchữ hai"


def test_sections_parents_and_order(spark):
    rows = docs.sections(spark.createDataFrame([("a", "Tên bài", BODY), ("b", "T", ""), ("c", "T", None)], "article_id string, title string, body string")).orderBy("order").collect()
    assert [(r["order"], r.section_title, r.section_level, r.parent, r.text) for r in rows] == [
        (0, "Tóm tắt", 2, None, "mở đầu"),
        (1, "Một", 2, None, "chữ một"),
        (2, "Con", 3, "Một", "chữ con"),
        (3, "Khác", 1, "Một", "chữ khác"),
        (4, "Sau", 3, "Một", "chữ sau"),
        (5, "Hai", 2, None, "chữ hai"),
    ]


def test_chunks_stay_in_budget_and_lose_nothing():
    parts = [{"section_title": f"M{i}", "section_level": 2, "parent": None, "text": " ".join(f"w{i}_{j}." for j in range(n))} for i, n in enumerate((10, 20, 400, 5, 5))]
    got = docs.chunk_article("T", parts, 120)
    words = [w for c in got for w in c["text"].split() if w.startswith("w")]
    assert {w for p in parts for w in p["text"].split()} == set(words)
    assert all(docs.words_and_half(c["contextualized_text"]) <= 120 + 20 for c in got)
    assert [c["n_sections"] for c in got][0] == 2 and got[-1]["n_sections"] == 2


def test_paragraph_overlap_and_sentences():
    assert docs.split_paragraphs("a b c\n\nd e f\n\ng h i", 10) == ["a b c\n\nd e f", "d e f\n\ng h i"]
    assert docs.split_sentences("A b. C d! E f?", 4) == ["A b.", "C d!", "E f?"]
    assert docs.split_paragraphs("", 10) == [] and docs.split_sentences(" ", 5) == []


def test_clean_body(spark):
    body = "\r\n# Tên **bài**\r\n# Tên bài\r\n\r\n\r\n\r\nchia sẻ: x\nCopyright 2020\nchữ\n## Chia sẻ: thật\n"
    row = spark.createDataFrame([(body, "Tên bài")], "b string, t string").select(docs.clean_body(F.col("b"), F.col("t")).alias("x")).first()
    assert row.x == "# Tên **bài**\n\nchữ\n## Chia sẻ: thật"


def test_ids_and_folds(spark):
    row = spark.createDataFrame([(" **Đau Đầu** (nặng): ", "k")], "a string, b string").select(
        t.fold("a").alias("f"), t.fold_name("a").alias("n"), t.fold_alnum("a").alias("al"), t.slugify("a").alias("s"), t.uuid5("b").alias("u"), t.display_name("a").alias("d")
    ).first()
    assert (row.f, row.n, row.al, row.s, row.d) == ("**dau dau** (nang):", "dau dau (nang", "dau dau nang", "dau-dau-nang", "Đau Đầu (nặng")
    assert row.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "k"))


def test_keyword_cleaning(spark):
    words = F.array(*[F.lit(x) for x in (" Ho, ", "ho", "một hai ba bốn năm sáu bảy tám chín", "", "Sốt  cao.")])
    row = spark.range(1).select(keywords.clean_keywords(words).alias("w"), keywords.intent(F.lit("Ho khan có thể là bệnh gì?")).alias("i"), keywords.relation_types(F.lit("xyz")).alias("r")).first()
    assert row.w == ["Ho", "Sốt cao"] and row.i == "symptom_diagnosis" and row.r is None
