"""Problem 6: lines repeated across one source's articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phloem.llm.sitelines import repeated_blocks, site_lines, without_site_lines
from phloem.storage import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines(table(spark, sf_dir, "articles"), "article_id")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_site_lines(table(spark, sf_dir, "articles").select("article_id", "source", "body"), "article_id")


def p6_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_blocks(table(spark, sf_dir, "articles"), "article_id")


QUERIES = {"p6_found": p6_found, "p6_clean": p6_clean, "p6_blocks": p6_blocks}
SQL = {
    "p6_found": r"""
WITH b AS (SELECT DISTINCT article_id, source, body FROM articles WHERE source IS NOT NULL AND body IS NOT NULL AND article_id IS NOT NULL),
s AS (SELECT article_id, source, string_split(body, chr(10)) AS lines FROM b),
e AS (SELECT article_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM s),
n AS (
  SELECT article_id, source, CAST(line_no AS INTEGER) AS line_no,
    regexp_replace(lower(trim(regexp_replace(line, '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+', ' ', 'g'))), '[0-9]+', '0', 'g') AS t
  FROM e
), c AS (SELECT * FROM n WHERE t NOT LIKE '#%' AND regexp_matches(t, '\p{L}')),
g AS (SELECT source, t FROM c GROUP BY source, t HAVING count(DISTINCT article_id) >= 5)
SELECT DISTINCT c.article_id, c.line_no FROM c JOIN g USING (source, t)
""",
}
