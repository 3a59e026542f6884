"""Writers: Markdown articles with front matter, JSON lines, evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phloem.functions.text import slugify


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def markdown_text(articles: DataFrame) -> DataFrame:
    """(file_name, value): front matter, title heading and body; null fields are left out of the front matter."""
    fields = ["source", "url", "title", "description", "author", "published_at", "updated_at", "category", "crawled_at"]
    lines = [F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{f}: "), _quoted(F.col(f).cast("string")))) for f in fields]
    links = F.when(F.size("related_links") > 0, F.concat(F.lit("related_links:\n"), F.array_join(F.transform("related_links", lambda x: F.concat(F.lit("  - "), _quoted(x))), "\n")))
    front = F.array_join(F.array_compact(F.array(*lines, links)), "\n")
    name = F.concat(slugify("source"), F.lit("__"), slugify("title"), F.lit("__"), F.substring(F.md5(F.coalesce("url", "title", F.lit(""))), 1, 8), F.lit(".md"))
    return articles.select(name.alias("file_name"), F.concat(F.lit("---\n"), front, F.lit("\n---\n\n# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("value"))


def write_markdown(articles: DataFrame, path: str) -> None:
    """One folder a file name, so that every article is a text file of its own and tasks write in parallel."""
    markdown_text(articles).write.mode("overwrite").partitionBy("file_name").option("lineSep", "\n").text(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Evaluation rows as JSON lines and the summary as CSV with a header."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    summary.write.mode("overwrite").option("header", True).csv(f"{path}/summary")
