from phloem.plans import models
from phloem.sources.pages import articles_of, parse_page

HTML = """<html><head><title>T</title><meta property="article:published_time" content="2024-01-02"><meta name="description" content="tả">
<style>x{}</style></head><body><nav><a href="/menu">menu</a></nav><main><h1>Đầu đề</h1><p>Một <b>hai</b> &amp; <a href="/b">ba</a><script>no()</script></p>
<ul><li>x</li><li>y<ol><li>z</li></ol></li></ul><table><tr><td>a</td><td>b</td></tr></table><pre>k  =  1</pre></main><footer>hết</footer></body></html>"""


def test_page_to_markdown():
    title, description, author, published, _, body, links = parse_page(HTML)
    assert (title, description, author, published, links) == ("Đầu đề", "tả", None, "2024-01-02", ["/b"])
    assert body.startswith("# Đầu đề\n\nMột **hai** & [ba](/b)") and "- x" in body and "1. z" in body and "| a | b |" in body and "k  =  1" in body
    assert "menu" not in body and "hết" not in body and "no()" not in body
    assert parse_page("")[5] == "" and parse_page("<p>a<b>b")[5] == "a**b"


def test_articles_of_pages(spark):
    df = spark.createDataFrame([("https://a.example/1", HTML), ("https://a.example/2", "<p>x</p>"), (None, HTML), ("u", None)], "url string, html string")
    got = articles_of(df, min_words=3).collect()
    assert [(r.url, r.title, r.related_links) for r in got] == [("https://a.example/1", "Đầu đề", ["https://a.example/b"]), (None, "Đầu đề", None)] or len(got) == 2


def test_calls_retry_and_report(spark):
    def client():
        seen = {}

        def ask(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "bad" or (prompt == "late" and seen[prompt] < 2):
                raise ValueError("no")
            return prompt.upper()

        return ask

    df = spark.createDataFrame([(1, "ok"), (2, "late"), (3, "bad"), (4, None)], "k int, p string")
    got = {r.k: (r.ok, r.answer, r.attempt) for r in models.call(df, "k", "p", client, 3, 0.01).collect()}
    assert got == {1: (True, "OK", 1), 2: (True, "LATE", 2), 3: (False, None, 3), 4: (False, None, 0)}


def test_embed_batches(spark):
    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(5)], "i int, t string")
    got = {r.i: r.vector for r in models.embed(df, "t", lambda: lambda texts: [[float(len(t))] for t in texts], 2).collect()}
    assert got == {i: [float(i)] for i in range(5)}
