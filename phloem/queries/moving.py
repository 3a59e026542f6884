"""Sources, sinks and streams over the project's tables: what is written is read again, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phloem import storage
from phloem.queries.building import replay
from phloem.queries.building_sql import _RECORDS
from phloem.queries.graph import BASE, Graph
from phloem.sources import pages, readers, writers
from phloem.storage import Stage, table
from phloem.streaming import ingest


def _markdown_files(spark: SparkSession, d: str) -> DataFrame:
    """Current articles written as Markdown files with front matter and read again."""
    stage = Stage(spark, "markdown")
    articles = Graph(spark, d).articles.filter("trim(title) <> '' and body is not null")
    writers.write_markdown(articles.withColumn("body", F.regexp_replace("body", "\r", "")), f"{stage.root}/files")
    read = readers.markdown_articles(spark, f"{stage.root}/files", "*.txt")
    return read.select("article_id", "title", "url", F.size("related_links").alias("n_links"), F.md5("body").alias("body"))


def _extraction_lines(spark: SparkSession, d: str) -> DataFrame:
    """Extraction records appended as JSON lines in two runs and read again."""
    records, _ = replay(spark, d)
    path = f"{Stage(spark, 'lines').root}/records"
    for run in (records.filter("ok"), records.filter("not ok")):
        writers.append_json(run, path)
    return readers.extractions(spark, path).select("chunk_id", "ok", F.size("entities").alias("n_entities"), F.size("relations").alias("n_relations"))


def _report(spark: SparkSession, d: str) -> DataFrame:
    """An evaluation report, rows and summary, written and its summary read again."""
    path = f"{Stage(spark, 'report').root}/report"
    rows = table(spark, d, "events").select(F.col("event_type").alias("method"), "value")
    writers.write_report(rows, rows.groupBy("method").agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("top")), path)
    return spark.read.csv(f"{path}/summary", header=True, schema="method string, n long, top double").join(spark.read.json(f"{path}/rows").groupBy("method").agg(F.count("*").alias("n_rows")), "method")


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """Articles taken in by a stream that ends, and the last write of each."""
    root = Stage(spark, "stream").root
    source = table(spark, d, "articles").select("article_id", "url", "ingested_at")
    source.write.mode("overwrite").parquet(f"{root}/in")
    ingest.ingest_stream(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", source.schema).awaitTermination()
    return ingest.current(spark, f"{root}/out").select("article_id", "ingested_at")


def _event_windows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.windowed_counts(table(spark, d, "events"), "ts", "1 hour", "2 hours", "event_type")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Web pages made of crawled items, parsed to articles of at least 50 words."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))
    items = table(spark, d, "article_items").filter("markdown is not null and url is not null").select("url", plain("title").alias("title"), plain("markdown").alias("body")).distinct().filter("title <> ''")
    html = F.concat(F.lit("<html><head><title>site</title></head><body><nav><a href='/x'>menu</a></nav><h1>"), "title", F.lit("</h1><p>"), "body", F.lit("</p><script>no()</script></body></html>"))
    found = pages.articles_of(items.withColumn("html", html), min_words=50)
    return found.select("url", "title", F.md5(F.regexp_replace("markdown", r"\s+", " ")).alias("text"))


def _chunk_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 chunks by article and place; the limit is the feature."""
    return Graph(spark, d).chunks.orderBy(F.asc_nulls_first("article_id"), F.asc_nulls_first("chunk_index"), "chunk_id").limit(100).select("chunk_id", "article_id", "chunk_index")


def _collections(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a collection as it is made, filled, made anew and dropped."""
    path = f"{Stage(spark, 'collections').root}/points"
    counts = [("missing", storage.count_rows(spark, path))]
    storage.ensure(spark, path, "point_id string")
    counts.append(("made", storage.count_rows(spark, path)))
    table(spark, d, "vector_points").select("point_id").distinct().write.mode("append").parquet(path)
    counts.append(("filled", storage.ensure(spark, path, "point_id string").count()))
    storage.ensure(spark, path, "point_id string", recreate=True)
    counts.append(("anew", storage.count_rows(spark, path)))
    storage.drop(spark, path)
    counts.append(("dropped", storage.count_rows(spark, path)))
    return spark.createDataFrame(counts, "step string, n long")


QUERIES = {
    "markdown_files": _markdown_files, "extraction_lines": _extraction_lines, "report_files": _report, "streamed_articles": _streamed, "event_windows": _event_windows, "parsed_pages": _pages, "chunk_scan": _chunk_scan, "collections": _collections,
}

_PLAIN = lambda c: f"trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
SQL = {
    "markdown_files": BASE + """SELECT 'article_' || substr(md5(coalesce(nullif(url, ''), trim(title))), 1, 12) AS article_id, trim(title) AS title, nullif(url, '') AS url, CAST(coalesce(len(related_links), 0) AS INTEGER) AS n_links,
md5(regexp_replace('# ' || title || chr(10) || chr(10) || replace(body, chr(13), ''), '^\\s+|\\s+$', '', 'g')) AS body FROM art WHERE trim(title) <> '' AND body IS NOT NULL""",
    "extraction_lines": _RECORDS + """, a AS (SELECT chunk_id, CAST(count(*) AS INTEGER) AS n_relations FROM met GROUP BY chunk_id), b AS (SELECT chunk_id, CAST(count(*) AS INTEGER) AS n_entities FROM (SELECT DISTINCT chunk_id, sname, subject_type, description, evidence_text FROM met) GROUP BY chunk_id)
SELECT chunk_id, ok, n_entities, n_relations FROM okc JOIN a USING (chunk_id) JOIN b USING (chunk_id)""",
    "report_files": "SELECT event_type AS method, count(*) AS n, round(max(value), 4) AS top, count(*) AS n_rows FROM events GROUP BY event_type",
    "streamed_articles": "SELECT article_id, max(ingested_at) AS ingested_at FROM articles WHERE article_id IS NOT NULL GROUP BY article_id",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "parsed_pages": f"""WITH a AS (SELECT DISTINCT url, {_PLAIN("title")} AS title, {_PLAIN("markdown")} AS body FROM article_items WHERE markdown IS NOT NULL AND url IS NOT NULL)
SELECT url, title, md5('# ' || title || ' ' || body) AS text FROM a WHERE title <> '' AND len(list_filter(string_split('# ' || title || ' ' || body, ' '), lambda w: w <> '')) >= 50""",
    "chunk_scan": BASE + "SELECT chunk_id, article_id, chunk_index FROM ch ORDER BY article_id NULLS FIRST, chunk_index NULLS FIRST, chunk_id LIMIT 100",
    "collections": "SELECT 'missing' AS step, 0 AS n UNION ALL SELECT 'made', 0 UNION ALL SELECT 'filled', count(DISTINCT point_id) FROM vector_points WHERE point_id IS NOT NULL UNION ALL SELECT 'anew', 0 UNION ALL SELECT 'dropped', 0",
}
