"""Problem 2: groups of synonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phloem.llm.groups import connected_groups, synonym_links
from phloem.storage import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = synonym_links(table(spark, sf_dir, "relations"))
    return connected_groups(links, "subject_entity_id", "object_entity_id", "entity_id", "group_id")


QUERIES = {"p2_found": p2_found}
SQL = {
    "p2_found": """
WITH RECURSIVE e AS (
  SELECT subject_entity_id AS a, object_entity_id AS b FROM relations
  WHERE upper(regexp_replace(relation_type, '^\\s+|\\s+$', '', 'g')) = 'DONG_NGHIA_VOI' AND subject_entity_id <> object_entity_id
), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS entity_id, a AS reached FROM l UNION SELECT r.entity_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT entity_id, min(reached) AS group_id FROM r GROUP BY entity_id
""",
}
