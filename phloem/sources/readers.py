"""Readers of what the pipeline takes in: Markdown files, url lists, questions, extraction records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phloem.functions.text import stable_id

_ARTICLE = "title string, source string, url string, description string, author string, published_at string, updated_at string, category string, crawled_at string, related_links array<string>"
EXTRACTION = (
    "ok boolean, chunk_id string, chunk_index int, article_id string, title string, section string, subsection string, source_url string, "
    "entities array<struct<name:string,entity_type:string,aliases:array<string>,surface_forms:array<string>,description:string,evidence_text:string>>, "
    "relations array<struct<subject:string,subject_type:string,relation_type:string,object:string,object_type:string,description:string,keywords:array<string>,evidence_text:string,confidence:double>>, "
    "attempt int, error string"
)


def _front(text: str) -> dict:
    try:
        found = yaml.safe_load(text) if text else {}
    except yaml.YAMLError:
        found = {}
    return found if isinstance(found, dict) else {}


def markdown_articles(spark: SparkSession, path: str, names: str = "*.md") -> DataFrame:
    """A row a ``*.md`` file: its front matter's fields, body and file path, with article_id from url or title.

    What ``writers.write_markdown`` wrote is read with the names ``*.txt``.

    A file without front matter, or with one that is no YAML mapping, is all body. Dates stay strings. Where no title is
    given, the first first-level heading is it, else the file's name.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter=names, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    fence = r"(?s)^\x{FEFF}?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)(.*)$"
    cut = files.select("file_path", F.regexp_extract("value", fence, 1).alias("front"), F.when(F.col("value").rlike(fence), F.regexp_extract("value", fence, 2)).otherwise(F.col("value")).alias("body"))

    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _ARTICLE.split(", ")]
        for batch in batches:
            rows = []
            for found in map(_front, batch):
                links = found.get("related_links")
                rows.append([None if found.get(n) is None else str(found[n]) for n in names[:-1]] + [[str(x) for x in links] if isinstance(links, list) else []])
            yield pd.DataFrame(rows, columns=names)

    meta = cut.withColumn("m", F.pandas_udf(parse, _ARTICLE)("front")).select("file_path", "body", "m.*")
    heading = F.nullif(F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1), F.lit(""))
    titled = meta.withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), heading, F.regexp_extract("file_path", r"([^/]+)\.md$", 1)))
    return titled.withColumn("article_id", stable_id("article", F.coalesce(F.nullif("url", F.lit("")), "title"))).withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", ""))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url), distinct in no order: a JSON list, an object with selected_urls or urls, or a text file with # comments."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    as_list = F.from_json("value", "array<string>")
    as_object = F.from_json("value", "selected_urls array<string>, urls array<string>")
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    urls = F.when(F.col("value").startswith("["), as_list).when(F.col("value").startswith("{"), F.coalesce(as_object["selected_urls"], as_object["urls"])).otherwise(lines)
    return whole.select(F.explode(urls).alias("url")).filter("url is not null").distinct()


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, reference, expected_terms, difficulty) of a JSON list, or of an object's questions, items or data; rows without a question drop out."""
    item = "struct<question:string,reference:string,reference_answer:string,expected_answer:string,expected_terms:array<string>,expected_entities:array<string>,difficulty:string>"
    whole = spark.read.text(path, wholetext=True)
    named = F.from_json("value", f"questions array<{item}>, items array<{item}>, data array<{item}>")
    rows = whole.select(F.explode(F.when(F.trim("value").startswith("["), F.from_json("value", f"array<{item}>")).otherwise(F.coalesce(named["questions"], named["items"], named["data"]))).alias("q")).select("q.*")
    found = rows.select("question", F.coalesce("reference", "reference_answer", "expected_answer").alias("reference"), F.coalesce("expected_terms", "expected_entities", F.array().cast("array<string>")).alias("expected_terms"), "difficulty")
    return found.filter("trim(question) <> ''")


def extractions(spark: SparkSession, path: str) -> DataFrame:
    """Extraction records, one JSON line a chunk, with a fixed schema; broken lines are rows of nulls that drop out."""
    return spark.read.schema(EXTRACTION).json(path).filter("chunk_id is not null")


def lenient_json(c: str, schema: str):
    """The object in a text that a model wrote around it: from the first brace to the last."""
    return F.from_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1), schema)


def hash_embeddings(texts: DataFrame, text: str, dim: int = 64) -> DataFrame:
    """A deterministic stand-in for an embedding model: signed word hashes, unit length, all in the JVM; null is as empty.

    A real model takes its place as a pandas UDF over an iterator of batches, loaded once a worker.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    signed = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dim)).alias("i"), F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(signed, F.lit(0.0), lambda a, x: a + F.when(x["i"] == i, x["s"]).otherwise(0.0)))
    norm = F.sqrt(F.aggregate("__raw", F.lit(0.0), lambda a, x: a + x * x))
    full = texts.withColumn("__raw", raw).withColumn("__norm", norm)
    return full.withColumn("vector", F.transform("__raw", lambda x: (x / F.greatest(F.col("__norm"), F.lit(1e-12))).cast("float"))).drop("__raw", "__norm")
