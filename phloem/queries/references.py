"""Queries of problem 5 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phloem.operators.references import orphan_counts, orphan_report, reference_status
from phloem.storage import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations, chunks, entities, articles = (table(spark, sf_dir, t) for t in ("relations", "chunks", "entities", "articles"))
    return (
        orphan_report(chunks, "chunks", "chunk_id", "article_id", F.col("article_id"), "ingested_at", articles, "article_id", "deleted_at", "ingested_at")
        .unionByName(orphan_report(relations, "relations", "relation_id", "subject_entity_id", F.col("subject_entity_id"), "ingested_at", entities, "entity_id", "deleted_at", "ingested_at"))
        .unionByName(orphan_report(relations, "relations", "relation_id", "evidence_chunk_ids", F.col("evidence_chunk_ids"), "ingested_at", chunks, "chunk_id", "deleted_at", "ingested_at"))
    )


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(p5_found(spark, sf_dir))


def p5_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose (article_id, source_url) agrees with no article, under partial match: a null part is left out."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "article_id", "source_url").distinct()
    found = reference_status(chunks, table(spark, sf_dir, "articles"), [("article_id", "article_id"), ("source_url", "url")], "partial")
    return found.select("chunk_id", "article_id", "source_url", "orphan_kind")


_FOUND = """
WITH r AS (
  SELECT 'chunks' AS table_name, chunk_id AS record_key, 'article_id' AS field_name, article_id AS ref, ingested_at AS seen FROM chunks
  UNION ALL SELECT 'relations', relation_id, 'subject_entity_id', subject_entity_id, ingested_at FROM relations
  UNION ALL SELECT 'relations', relation_id, 'evidence_chunk_ids', unnest(evidence_chunk_ids), ingested_at FROM relations
), k AS (
  SELECT table_name, record_key, field_name, regexp_replace(ref, '^\\s+|\\s+$', '', 'g') AS ref_key, seen FROM r
), p AS (
  SELECT 'article_id' AS field_name, article_id AS key, bool_or(deleted_at IS NULL) AS live, min(ingested_at) AS known FROM articles GROUP BY article_id
  UNION ALL SELECT 'subject_entity_id', entity_id, bool_or(deleted_at IS NULL), min(ingested_at) FROM entities GROUP BY entity_id
  UNION ALL SELECT 'evidence_chunk_ids', chunk_id, bool_or(deleted_at IS NULL), min(ingested_at) FROM chunks GROUP BY chunk_id
), f AS (
  SELECT k.table_name, k.record_key, k.field_name, k.ref_key,
    CASE WHEN p.key IS NULL THEN 'missing' WHEN NOT p.live THEN 'deleted' WHEN p.known > k.seen THEN 'late' END AS orphan_kind,
    strftime(k.seen, '%Y-%m') AS period_month
  FROM k LEFT JOIN p ON p.field_name = k.field_name AND p.key = k.ref_key
  WHERE k.ref_key IS NOT NULL AND k.ref_key <> ''
)
SELECT DISTINCT table_name, record_key, field_name, ref_key, orphan_kind, period_month FROM f WHERE orphan_kind IS NOT NULL
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_composite": p5_composite}
SQL = {
    "p5_found": _FOUND,
    "p5_report": f"""
SELECT table_name, field_name, orphan_kind, period_month, count(*) AS n_references, count(DISTINCT ref_key) AS n_keys
FROM ({_FOUND}) GROUP BY ALL
""",
    "p5_composite": """
SELECT DISTINCT chunk_id, article_id, source_url, 'missing' AS orphan_kind FROM chunks c
WHERE (article_id IS NOT NULL OR source_url IS NOT NULL)
  AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.article_id = c.article_id AND a.url = c.source_url AND c.article_id IS NOT NULL AND c.source_url IS NOT NULL)
  AND NOT (c.source_url IS NULL AND c.article_id IN (SELECT article_id FROM articles WHERE article_id IS NOT NULL))
  AND NOT (c.article_id IS NULL AND c.source_url IN (SELECT url FROM articles WHERE url IS NOT NULL))
""",
}
