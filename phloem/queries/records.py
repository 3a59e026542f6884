"""Queries of text functions, merges, validation, documents, vectors, keywords and evaluation, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phloem import schema
from phloem.functions import scores as s
from phloem.functions import text as t
from phloem.operators import docs, extract, graph, merge, vector
from phloem.plans import evaluate, keywords
from phloem.queries.graph import BASE, Graph
from phloem.storage import table


def _normalizers(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("name")
    rows = table(spark, d, "entities").select("name").union(table(spark, d, "documents").select("title")).distinct().filter("name is not null")
    return rows.select("name", t.fold(name).alias("folded"), t.fold_alnum(name).alias("alnum"), t.fold_name(name).alias("key"), t.slugify(name).alias("slug"), t.lower_collapsed(name).alias("lowered"))


def _stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("name", "entity_type").distinct().select("name", "entity_type", t.entity_id("name", "entity_type").alias("id"))


def _point_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vector_points").select("point_id", t.point_id("entity", F.col("payload.ref_id")).alias("uuid")).distinct()


def _relation_ids(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relations").select("subject_entity_id", "relation_type", "object_entity_id").distinct()
    return r.select("subject_entity_id", "relation_type", "object_entity_id", t.relation_id("subject_entity_id", graph.relation_kind(), "object_entity_id").alias("id"))


def _urls(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "article_items").select("url").distinct().filter("url is not null")
    return rows.select("url", t.url_normal("url").alias("normal"), t.url_slug("url").alias("slug"), t.url_host("url").alias("host"))


def _page_links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "article_items").select("item_id", F.explode(docs.links(F.col("markdown"))).alias("target"))
    return rows.groupBy(t.url_host("target").alias("host")).agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("target").alias("n_targets"))


def _same_site_links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "article_items").select("item_id", "url", F.explode(docs.links(F.col("markdown"))).alias("target"))
    return rows.filter(t.url_host("url") == t.url_host("target")).groupBy("item_id").agg(F.countDistinct("target").alias("n_links"))


def _entity_merge(spark: SparkSession, d: str) -> DataFrame:
    m = merge.merge_entities(table(spark, d, "entities"))
    return m.select("entity_id", "name", "normalized_name", "description", "mention_count", "source_count", F.array_join("aliases", "|").alias("aliases"), F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"), F.coalesce("n_surface_forms", F.lit(0)).alias("n_surface_forms"))


def _relation_merge(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    united = merge.set_union(x.raw["relations"], "relation_id", "keywords")
    n = x.links.groupBy("relation_id").agg(F.count("*").alias("n_evidence"))
    out = x.relations.join(united, "relation_id", "left").join(n, "relation_id", "left")
    return out.select("relation_id", "relation_type", "confidence", F.array_join("keywords", "|").alias("keywords"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def _article_upsert(spark: SparkSession, d: str) -> DataFrame:
    return Graph(spark, d).articles.select("article_id", "source", "title", F.md5("body").alias("body"))


def _mention_upsert(spark: SparkSession, d: str) -> DataFrame:
    m = Graph(spark, d).mentions
    return m.groupBy("chunk_id").agg(F.count("*").alias("n"), F.max("confidence").alias("top"))


def _profile_update(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of entities replaced by the evidence of the same row where there is any."""
    x = Graph(spark, d)
    updates = x.entities.select("entity_id", F.nullif(F.col("evidence_text"), F.lit("")).alias("description"))
    return merge.replace_texts(x.entities.select("entity_id", "description"), updates, "entity_id", ["description"])


def _pending(spark: SparkSession, d: str) -> DataFrame:
    """Urls that pages link to on their own host but that are not taken in yet, and pages that were crawled but not taken in."""
    items = table(spark, d, "article_items")
    linked = items.select("url", F.explode(docs.links(F.col("markdown"))).alias("target")).filter(t.url_host("url") == t.url_host("target")).select(t.url_normal("target").alias("url"))
    seen = linked.unionByName(items.select(t.url_normal("url").alias("url"))).unionByName(items.select(F.explode("related_links").alias("url")).select(t.url_normal("url").alias("url"))).filter("url is not null").distinct()
    return seen.join(table(spark, d, "articles").select(t.url_normal("url").alias("url")), "url", "left_anti")


def _page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 50 entities, most mentioned first; paging is the feature."""
    return Graph(spark, d).entities.orderBy(F.desc_nulls_last("mention_count"), "entity_id").offset(50).limit(50).select("entity_id", "mention_count")


def _valid_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").filter("name is not null").withColumn("seq", F.struct("ingested_at", "entity_id", "name"))
    return extract.valid_entities(rows, "seq").select("key", "entity_type", "name", F.md5("evidence_text").alias("evidence"))


def _named_relations(x: Graph) -> DataFrame:
    end = lambda p: x.entities.select(F.col("entity_id").alias(f"{p}_entity_id"), F.col("name").alias(p), F.col("entity_type").alias(f"{p}_type"))
    rows = x.raw["relations"].join(end("subject"), "subject_entity_id").join(end("object"), "object_entity_id")
    return rows.withColumn("relation_type", graph.relation_kind()).withColumn("seq", F.struct("ingested_at", "relation_id"))


def _valid_relations(spark: SparkSession, d: str) -> DataFrame:
    return extract.valid_relations(_named_relations(Graph(spark, d)), "seq").select("subject_key", "subject_type", "relation_type", "object_key", "object_type", "relation_id")


def _missing_ends(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").filter("name is not null").withColumn("seq", F.struct("ingested_at", "entity_id", "name"))
    return extract.missing_ends(extract.valid_entities(rows, "seq"), extract.valid_relations(_named_relations(Graph(spark, d)), "seq"))


def _schema_audit(spark: SparkSession, d: str) -> DataFrame:
    """Relations by type and whether the schema allows their ends."""
    x = Graph(spark, d)
    rules = schema.rules(spark).withColumn("allowed", F.lit(True))
    rows = _named_relations(x).join(F.broadcast(rules), ["relation_type", "subject_type", "object_type"], "left")
    return rows.groupBy("relation_type", F.coalesce("allowed", F.lit(False)).alias("allowed")).agg(F.count("*").alias("n"), F.countDistinct("relation_id").alias("n_relations"))


def _extraction_audit(spark: SparkSession, d: str) -> DataFrame:
    """Counts by relation type: rows, distinct relations, rows without keywords, rows with an unusable confidence."""
    rows = table(spark, d, "relations").groupBy(graph.relation_kind().alias("relation_type"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("relation_id").alias("n_relations"), F.count_if(F.coalesce(F.size("keywords"), F.lit(0)) <= 0).alias("no_keywords"), F.count_if(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))).alias("bad_confidence"))


def _md_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").filter("body is not null").select("article_id", "title", "body").distinct()
    return rows.select("article_id", F.md5(docs.clean_body(F.col("body"), F.coalesce("title", F.lit("")))).alias("cleaned"), F.length("body").alias("n_before"))


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return Graph(spark, d).articles.filter("body is not null").select("article_id", "title", "body")


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return docs.sections(_articles(spark, d)).withColumn("text", F.md5("text")).withColumnRenamed("order", "section_order")


def _chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d)
    return docs.chunks(docs.sections(a), a, 300)


def _token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", t.tokens_estimate("text").alias("tokens"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", t.sentences("text").alias("x"))
    return rows.select("doc_id", F.size("x").alias("n"), F.md5(F.array_join("x", "|")).alias("joined"))


def _vector(metric: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        e = table(spark, d, "embeddings").select("vec_id", "embedding")
        asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
        found = vector.topk(asked, e, 10, metric, "query_id", "vector", "vec_id", "embedding")
        return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")

    return query


def _vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = vector.topk(asked, vector.payload_filter(e, {"label": [1, 3, 5], "vec_id": None}), 5, "cosine", "query_id", "vector", "vec_id", "embedding")
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _vector_write(spark: SparkSession, d: str) -> DataFrame:
    """Points after an upsert of relabelled ones and a deletion."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), "label")
    a = e.filter("point_id % 7 = 0").select("point_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("seq"))
    b = e.filter("point_id % 14 = 0").select(F.col("point_id"), (F.col("label") + 200).alias("label"), F.lit(2).alias("seq"))
    new = e.filter("point_id % 50 = 0").select((F.col("point_id") + 1_000_000).alias("point_id"), "label", F.lit(3).alias("seq"))
    return vector.delete(vector.upsert(e, a.unionByName(b).unionByName(new)), e.filter("point_id % 10 = 3"))


def _keywords(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("title")
    rows = table(spark, d, "articles").select("title").union(table(spark, d, "documents").select("section")).union(table(spark, d, "chunks").select("section")).distinct().filter("title is not null")
    return rows.select("title", F.array_join(keywords.high_keywords(q), "|").alias("high"), keywords.intent(q).alias("intent"), F.array_join(keywords.relation_types(q), "|").alias("types"))


def _keyword_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "relations").select("relation_id", "keywords").distinct()
    return rows.select("relation_id", F.array_join(keywords.clean_keywords(F.concat(F.coalesce("keywords", F.array().cast("array<string>")), F.array(F.lit(" (Ho khan). "), F.lit("ho  khan"), F.lit("—"))), 3), "|").alias("words"))


def _evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's name as a question against the chunks that mention it, best confidence first."""
    x = Graph(spark, d)
    ranked = x.mentions.join(x.chunks.select("chunk_id", "text"), "chunk_id").select(F.col("entity_id").alias("query_id"), "chunk_id", "text", "confidence")
    ranked = graph.top_per_query(ranked, 10, F.desc("confidence"), F.asc("chunk_id"))
    expected = x.entities.filter("name is not null").select(F.col("entity_id").alias("query_id"), F.array("name").alias("terms"))
    return evaluate.retrieval_metrics(ranked, expected).withColumn("matched_terms", F.array_join("matched_terms", "|"))


def _method_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("method"), s.unit_score(F.col("value")).alias("faithfulness"), s.unit_score(F.col("value") / 10).alias("relevance"))
    return evaluate.summary(rows, ["faithfulness", "relevance"])


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(s.verdict(s.unit_score(F.col("value") / 10), s.unit_score(F.col("value"))).alias("verdict"))
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


def _context(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's context: its relations as lines, strongest first, five at most (the context's limit)."""
    x = Graph(spark, d)
    end = lambda p: x.entities.select(F.col("entity_id").alias(f"{p}_entity_id"), F.col("name").alias(f"{p}_name"))
    rows = x.relations.join(end("subject"), "subject_entity_id").join(end("object"), "object_entity_id")
    lines = rows.select(F.col("subject_entity_id").alias("query_id"), "relation_id", "confidence", F.concat(F.lit("- "), F.coalesce("subject_name", F.lit("")), F.lit(" --"), F.col("relation_type"), F.lit("--> "), F.coalesce("object_name", F.lit(""))).alias("line"))
    top = graph.top_per_query(lines, 5, F.desc("confidence"), F.asc("relation_id"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda z: z["line"]), "\n")
    return top.groupBy(F.col("query_id").alias("entity_id")).agg(joined.alias("context"))


def _ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    per = x.chunks.groupBy("article_id").agg(F.count("*").alias("n_chunks"), F.sum(F.coalesce("token_count", F.lit(0))).alias("n_tokens"))
    rows = x.articles.select("article_id", "source").join(per, "article_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n_articles"), F.sum(F.coalesce("n_chunks", F.lit(0))).alias("n_chunks"), F.sum(F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"), F.count_if(F.col("n_chunks").isNull()).alias("without_chunks"))


QUERIES = {
    "normalizers": _normalizers, "stable_ids": _stable_ids, "point_ids": _point_ids, "relation_ids": _relation_ids, "url_parts": _urls, "page_links": _page_links, "same_site_links": _same_site_links,
    "entity_merge": _entity_merge, "relation_merge": _relation_merge, "article_upsert": _article_upsert, "mention_upsert": _mention_upsert, "profile_update": _profile_update, "pending_urls": _pending,
    "page_offset": _page, "valid_entities": _valid_entities, "valid_relations": _valid_relations, "missing_ends": _missing_ends, "schema_audit": _schema_audit, "extraction_audit": _extraction_audit,
    "md_clean": _md_clean, "sections": _sections, "chunk_pack": _chunk_pack, "token_estimate": _token_estimate, "sentence_split": _sentences, "vector_topk_cosine": _vector("cosine"), "vector_topk_dot": _vector("dot"),
    "vector_topk_euclid": _vector("euclid"), "vector_filtered": _vector_filtered, "vector_write": _vector_write, "keyword_intents": _keywords, "keyword_clean": _keyword_clean, "retrieval_metrics": _evaluation,
    "method_summary": _method_summary, "verdicts": _verdicts, "context_assembly": _context, "ingest_summary": _ingest_summary,
}


def _fold(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(strip_accents(lower({x})), 'đ', 'd'), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'))"


def _alnum(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(strip_accents(lower({x})), 'đ', 'd'), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


_EDGES = "[ \\-–—:;,.()\\[\\]{}]+"


def _key(x: str) -> str:
    plain = f"regexp_replace(regexp_replace(regexp_replace(replace(strip_accents(regexp_replace(lower(trim({x})), '[*_]', '', 'g')), 'đ', 'd'), '[^\\x00-\\x7F]', '', 'g'), '[\"''`]', '', 'g'), '\\s+', ' ', 'g')"
    return f"trim(regexp_replace(trim({plain}), '^{_EDGES}|{_EDGES}$', '', 'g'))"


def _display(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '\\*\\*|__', '', 'g'), '^{_EDGES}|{_EDGES}$', '', 'g'))"


def _any(x: str, cues: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{c}')" for c in cues) + ")"


def _bad(x: str) -> str:
    return f"({x} IS NULL OR length({x}) < 2 OR len(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')) > 12 OR {_any(f'lower(trim({x}))', extract.BLOCKED)} OR {_any(_fold(x), extract.BLOCKED)})"


_VALID_ENTITIES = f"""
n AS (SELECT {_display("name")} AS name, trim(entity_type) AS entity_type, evidence_text, ingested_at, entity_id, name AS raw, mention_count FROM entities WHERE name IS NOT NULL),
k AS (SELECT *, {_fold("name")} AS key FROM n WHERE entity_type IN ({", ".join(f"'{x}'" for x in schema.ENTITY_TYPES)}) AND NOT {_bad("name")})
"""
_RULES = "rules(relation_type, subject_type, object_type) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in schema.allowed_ends()) + ")"
_NAMED = """named AS (
  SELECT r.relation_id, r.ingested_at, upper(trim(r.relation_type)) AS relation_type, trim(s.entity_type) AS subject_type, trim(o.entity_type) AS object_type, s.name AS sraw, o.name AS oraw, trim(r.evidence_text) AS evidence_text
  FROM relations r JOIN ent s ON s.entity_id = r.subject_entity_id JOIN ent o ON o.entity_id = r.object_entity_id
)"""
_TIGHT = f"regexp_replace(regexp_replace({_fold('evidence_text')}, '\\s*\\(\\s*', '(', 'g'), '\\s*\\)', ')', 'g')"
#: Whether a relation of the table d1, with folded ends and evidence, passes every rule.
_PASSES = f"""EXISTS (SELECT 1 FROM rules u WHERE u.relation_type = d1.relation_type AND u.subject_type = d1.subject_type AND u.object_type = d1.object_type)
    AND NOT {_bad("subject")} AND NOT {_bad("object")} AND evidence_text IS NOT NULL AND evidence_text <> '' AND NOT contains(evidence_text, '?')
    AND NOT ({" OR ".join(f"starts_with(lower(evidence_text), '{q}')" for q in extract.QUESTION_STARTS)})
    AND (relation_type <> 'DONG_NGHIA_VOI' OR (subject_type = object_type AND subject_key <> object_key AND NOT {_any("said", extract.SYNONYM_AGAINST)}
      AND ({_any("said", extract.SYNONYM_FOR)} OR (subject_key <> '' AND object_key <> '' AND (contains(tight, subject_key || '(' || object_key || ')') OR contains(tight, object_key || '(' || subject_key || ')'))))))
    AND (relation_type <> 'CHAN_DOAN_BANG' OR object_type = 'PHUONG_PHAP_CHAN_DOAN')"""
_KEYED = f"""d1 AS (SELECT *, {_fold("subject")} AS subject_key, {_fold("object")} AS object_key, {_TIGHT} AS tight, {_fold("evidence_text")} AS said FROM d0)"""
_VALID_RELATIONS = f"""{_NAMED}, {_RULES},
d0 AS (SELECT *, {_display("sraw")} AS subject, {_display("oraw")} AS object FROM named),
{_KEYED},
vr0 AS (SELECT * FROM d1 WHERE {_PASSES}),
vr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_key, subject_type, relation_type, object_key, object_type ORDER BY ingested_at NULLS FIRST, relation_id) AS rn FROM vr0) WHERE rn = 1)"""
_UUID5 = "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1 AS INTEGER), 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def _uuid5(name: str) -> str:
    """A version 5 UUID of a name in the namespace of urls."""
    return _UUID5.format(h=f"sha1(from_hex('{uuid.NAMESPACE_URL.hex}') || encode({name}))")


_QUESTION = "(SELECT title AS q FROM articles UNION SELECT section FROM documents UNION SELECT section FROM chunks)"
_INTENT = "CASE " + " ".join(f"WHEN {_any('f', cues)} THEN '{name}'" for name, cues in keywords.INTENT_CUES) + " ELSE 'general_fact' END"
_TYPES = "list_concat(" * (len(keywords.RELATION_CUES) - 1) + ", ".join(f"CASE WHEN {_any('f', cues)} THEN [{', '.join(repr(k) for k in kinds)}] ELSE [] END" + (")" if i else "") for i, (cues, kinds) in enumerate(keywords.RELATION_CUES))
_CANDIDATES = "(SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0) q, embeddings e"


def _topk(score: str, k: int, where: str = "TRUE") -> str:
    return f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.query_id, e.vec_id, round({score}, 9) AS score FROM {_CANDIDATES} WHERE {where})) WHERE rank <= {k}"


_D = lambda x: f"list_transform({x}, lambda z: CAST(z AS DOUBLE))"
_UNIT = lambda x: f"coalesce(greatest(0.0, least(1.0, CASE WHEN {x} > 5 THEN {x} / 10 WHEN {x} > 1 THEN {x} / 5 ELSE {x} END)), 0.0)"
_NOISE = "(?i)" + "|".join(docs.NOISE)
_HEADING = lambda x: f"trim(regexp_replace(regexp_replace(regexp_replace(trim({x}), '^#{{1,6}}\\s+', ''), '[*_]', '', 'g'), '\\s+', ' ', 'g'))"
_HOST = lambda x: f"lower(regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1))"
_PLAIN = lambda x: f"regexp_replace(regexp_replace(trim({x}), '[?#].*$', ''), '/+$', '')"

SQL = {
    "point_ids": f"SELECT DISTINCT point_id, {_uuid5("'entity::' || payload.ref_id")} AS uuid FROM vector_points",
    "normalizers": f"""SELECT name, {_fold("name")} AS folded, {_alnum("name")} AS alnum, {_key("name")} AS key,
coalesce(nullif(substring(regexp_replace(regexp_replace({_fold("name")}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 90), ''), 'untitled') AS slug, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS lowered
FROM (SELECT name FROM entities UNION SELECT title FROM documents) WHERE name IS NOT NULL""",
    "stable_ids": f"""SELECT DISTINCT name, entity_type, 'entity_' || substring(md5(coalesce(entity_type, '') || ':' || coalesce({_key("name")}, '')), 1, 12) AS id FROM entities""",
    "relation_ids": """SELECT DISTINCT subject_entity_id, relation_type, object_entity_id,
'relation_' || substring(md5(coalesce(subject_entity_id, '') || ':' || coalesce(upper(trim(relation_type)), '') || ':' || coalesce(object_entity_id, '')), 1, 12) AS id FROM relations""",
    "url_parts": f"""SELECT url, normal, regexp_extract(normal, '/([^/]+)$', 1) AS slug, {_HOST("url")} AS host FROM (
SELECT DISTINCT url, regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '') AS normal FROM article_items WHERE url IS NOT NULL)""",
    "page_links": f"""SELECT {_HOST("target")} AS host, count(DISTINCT item_id) AS n_items, count(DISTINCT target) AS n_targets
FROM (SELECT item_id, unnest(regexp_extract_all(markdown, '\\]\\((https?://[^()\\s]+)\\)', 1)) AS target FROM article_items) GROUP BY ALL""",
    "entity_merge": """
WITH b AS (
  SELECT entity_id, arg_min(name, struct_pack(i := ingested_at, v := name)) FILTER (trim(coalesce(name, '')) <> '') AS name,
    arg_min(normalized_name, struct_pack(i := ingested_at, v := normalized_name)) FILTER (trim(coalesce(normalized_name, '')) <> '') AS normalized_name,
    arg_min(description, struct_pack(i := ingested_at, v := description)) FILTER (trim(coalesce(description, '')) <> '') AS description,
    sum(coalesce(mention_count, 0)) AS mention_count, max(coalesce(source_count, 0)) AS source_count
  FROM entities WHERE entity_id IS NOT NULL GROUP BY entity_id
), a AS (SELECT entity_id, string_agg(x, '|' ORDER BY x) AS aliases, count(*) AS n_aliases FROM (SELECT DISTINCT entity_id, x FROM (SELECT entity_id, unnest(aliases) AS x FROM entities) WHERE trim(x) <> '') GROUP BY entity_id),
f AS (SELECT entity_id, count(*) AS n FROM (SELECT DISTINCT entity_id, x FROM (SELECT entity_id, unnest(surface_forms) AS x FROM entities) WHERE trim(x) <> '') GROUP BY entity_id)
SELECT b.*, a.aliases, coalesce(a.n_aliases, 0) AS n_aliases, coalesce(f.n, 0) AS n_surface_forms FROM b LEFT JOIN a USING (entity_id) LEFT JOIN f USING (entity_id)""",
    "relation_merge": BASE + """, k AS (SELECT relation_id, string_agg(x, '|' ORDER BY x) AS keywords FROM (SELECT DISTINCT relation_id, x FROM (SELECT relation_id, unnest(keywords) AS x FROM relations) WHERE trim(x) <> '') GROUP BY relation_id),
n AS (SELECT relation_id, count(*) AS n FROM ev GROUP BY relation_id)
SELECT r.relation_id, r.relation_type, r.confidence, k.keywords, coalesce(n.n, 0) AS n_evidence FROM rel r LEFT JOIN k USING (relation_id) LEFT JOIN n USING (relation_id)""",
    "article_upsert": BASE + "SELECT article_id, source, title, md5(body) AS body FROM art",
    "mention_upsert": BASE + "SELECT chunk_id, count(*) AS n, max(confidence) AS top FROM men GROUP BY chunk_id",
    "profile_update": BASE + "SELECT entity_id, coalesce(nullif(evidence_text, ''), description) AS description FROM ent",
    "pending_urls": f"""WITH l AS (SELECT url, unnest(regexp_extract_all(markdown, '\\]\\((https?://[^()\\s]+)\\)', 1)) AS target FROM article_items WHERE markdown IS NOT NULL),
s AS (SELECT {_PLAIN("target")} AS url FROM l WHERE {_HOST("url")} = {_HOST("target")} UNION SELECT {_PLAIN("url")} FROM article_items UNION SELECT {_PLAIN("u")} FROM (SELECT unnest(related_links) AS u FROM article_items))
SELECT url FROM s WHERE url IS NOT NULL AND url NOT IN (SELECT {_PLAIN("url")} FROM articles WHERE url IS NOT NULL)""",
    "page_offset": BASE + "SELECT entity_id, mention_count FROM ent ORDER BY mention_count DESC NULLS LAST, entity_id LIMIT 50 OFFSET 50",
    "valid_entities": f"""WITH {_VALID_ENTITIES}
SELECT key, entity_type, arg_min(name, struct_pack(i := ingested_at, e := entity_id, r := raw)) AS name,
md5(coalesce(arg_min(trim(evidence_text), struct_pack(i := ingested_at, e := entity_id, r := raw, v := trim(evidence_text))) FILTER (trim(coalesce(evidence_text, '')) <> ''), '')) AS evidence FROM k GROUP BY key, entity_type""",
    "valid_relations": BASE + f", {_VALID_RELATIONS} SELECT subject_key, subject_type, relation_type, object_key, object_type, relation_id FROM vr",
    "missing_ends": BASE + f""", {_VALID_RELATIONS}, {_VALID_ENTITIES}, ends AS (SELECT subject_key AS key, subject_type AS entity_type FROM vr UNION SELECT object_key, object_type FROM vr)
SELECT key, entity_type FROM ends e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.key = e.key AND k.entity_type = e.entity_type)""",
    "schema_audit": BASE + f", {_NAMED}, {_RULES} SELECT n.relation_type, u.relation_type IS NOT NULL AS allowed, count(*) AS n, count(DISTINCT n.relation_id) AS n_relations FROM named n LEFT JOIN rules u ON u.relation_type = n.relation_type AND u.subject_type = n.subject_type AND u.object_type = n.object_type GROUP BY 1, 2",
    "extraction_audit": """SELECT upper(trim(relation_type)) AS relation_type, count(*) AS n, count(DISTINCT relation_id) AS n_relations,
count(*) FILTER (coalesce(len(keywords), 0) = 0) AS no_keywords, count(*) FILTER (NOT coalesce(confidence BETWEEN 0 AND 1, FALSE)) AS bad_confidence FROM relations GROUP BY 1""",
    "token_estimate": "SELECT doc_id, CAST(floor(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 1.5) AS INTEGER) AS tokens FROM documents WHERE text IS NOT NULL",
    "sentence_split": """WITH t AS (SELECT doc_id, trim(text) AS x FROM documents WHERE text IS NOT NULL), s AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(x, '([.!?。])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda z: trim(z)), lambda z: z <> '') AS l FROM t)
SELECT doc_id, CAST(len(l) AS INTEGER) AS n, md5(array_to_string(l, '|')) AS joined FROM s""",
    "sections": BASE + """, a AS (SELECT article_id, title, unnest(string_split_regex(body, '\\r\\n|\\n|\\r')) AS line, generate_subscripts(string_split_regex(body, '\\r\\n|\\n|\\r'), 1) AS pos FROM art WHERE body IS NOT NULL),
b AS (SELECT *, length(regexp_extract(trim(line), '^(#{1,6})\\s+\\S', 1)) AS level, trim(regexp_replace(regexp_extract(trim(line), '^#{1,6}\\s+(.+?)\\s*$', 1), '\\*\\*|__', '', 'g')) AS heading FROM a),
c AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER w AS part, last_value(CASE WHEN level = 2 THEN heading END IGNORE NULLS) OVER w AS above
  FROM b WHERE NOT coalesce(level = 1 AND heading = title, FALSE) WINDOW w AS (PARTITION BY article_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, last_value(CASE WHEN level >= 3 THEN coalesce(above, chr(1)) WHEN level = 2 THEN chr(1) END IGNORE NULLS) OVER (PARTITION BY article_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS kept FROM c),
e AS (SELECT article_id, part, max(CASE WHEN level > 0 THEN heading END) AS h, max(level) AS l, max(CASE WHEN level > 0 THEN kept END) AS p,
  regexp_replace(coalesce(string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY pos), ''), '^\\s+|\\s+$', '', 'g') AS text FROM d GROUP BY article_id, part),
f AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY part) - 1 AS n FROM e WHERE text <> '')
SELECT article_id, CAST(n AS INTEGER) AS section_order, 'section_' || substring(md5(article_id || ':' || n || ':' || coalesce(h, 'Tóm tắt')), 1, 12) AS section_id, coalesce(h, 'Tóm tắt') AS section_title,
CASE WHEN l > 0 THEN l ELSE 2 END AS section_level, nullif(p, chr(1)) AS parent, md5(text) AS text FROM f""",
    "same_site_links": f"""WITH l AS (SELECT item_id, url, regexp_extract_all(markdown, '\\]\\((https?://[^()\\s]+)\\)', 1) AS a FROM article_items WHERE markdown IS NOT NULL),
k AS (SELECT item_id, url, unnest(a) AS target FROM l)
SELECT item_id, count(DISTINCT target) AS n_links FROM k WHERE {_HOST("url")} = {_HOST("target")} GROUP BY item_id""",
    "md_clean": f"""WITH a AS (SELECT DISTINCT article_id, title, body FROM articles WHERE body IS NOT NULL),
l AS (SELECT *, string_split(regexp_replace(regexp_replace(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), chr(10)) AS lines FROM a),
f AS (SELECT *, list_transform(lines, lambda z: starts_with(trim(z), '# ') AND {_HEADING("z")} = {_HEADING("coalesce(title, '')")}) AS h FROM l),
k AS (SELECT *, list_filter(lines, lambda z, i: NOT regexp_matches(trim(z), '{_NOISE}') AND (NOT h[i] OR i = list_position(h, TRUE))) AS kept FROM f)
SELECT article_id, md5(regexp_replace(regexp_replace(array_to_string(kept, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS cleaned, CAST(length(body) AS INTEGER) AS n_before FROM k""",
    "vector_topk_cosine": _topk(f"list_cosine_similarity({_D('q.v')}, {_D('e.embedding')})", 10),
    "vector_topk_dot": _topk(f"list_inner_product({_D('q.v')}, {_D('e.embedding')})", 10),
    "vector_topk_euclid": _topk(f"-list_distance({_D('q.v')}, {_D('e.embedding')})", 10),
    "vector_filtered": _topk(f"list_cosine_similarity({_D('q.v')}, {_D('e.embedding')})", 5, "e.label IN (1, 3, 5)"),
    "vector_write": """WITH e AS (SELECT vec_id AS point_id, CASE WHEN vec_id % 14 = 0 THEN label + 200 WHEN vec_id % 7 = 0 THEN label + 100 ELSE label END AS label FROM embeddings
UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 50 = 0) SELECT point_id, label FROM e WHERE point_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 10 = 3)""",
    "keyword_intents": f"""WITH a AS (SELECT q AS title, lower(q) AS l, {_alnum("q")} AS f FROM {_QUESTION} WHERE q IS NOT NULL),
b AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {_any('l', cues)} THEN '{w}' END" for cues, w in keywords.KEYWORD_CUES)}], lambda z: z IS NOT NULL) AS h, {_INTENT} AS intent, {_TYPES} AS t FROM a)
SELECT title, CASE WHEN len(h) > 0 THEN array_to_string(h, '|') ELSE 'thông tin y khoa' END AS high, intent,
CASE WHEN intent = 'symptom_diagnosis' THEN '{"|".join(keywords.SYMPTOM_RELATIONS)}' WHEN len(t) > 0 THEN array_to_string(list_filter(t, lambda z, i: list_position(t, z) = i), '|') END AS types FROM b""",
    "retrieval_metrics": BASE + """, r AS (SELECT * FROM (SELECT m.entity_id, c.text, row_number() OVER (PARTITION BY m.entity_id ORDER BY m.confidence DESC, m.chunk_id) AS rank FROM men m JOIN ch c USING (chunk_id)) WHERE rank <= 10),
t AS (SELECT entity_id, name, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS term FROM ent WHERE name IS NOT NULL),
f AS (SELECT t.entity_id, any_value(t.name) AS name, min(CASE WHEN contains(trim(regexp_replace(lower(coalesce(r.text, '')), '\\s+', ' ', 'g')), t.term) THEN r.rank END) AS k FROM t LEFT JOIN r USING (entity_id) WHERE t.term <> '' GROUP BY t.entity_id)
SELECT entity_id AS query_id, k AS first_hit_rank, CAST(coalesce(k <= 1, FALSE) AS INTEGER) AS hit_at_1, CAST(coalesce(k <= 3, FALSE) AS INTEGER) AS hit_at_3, CAST(coalesce(k <= 5, FALSE) AS INTEGER) AS hit_at_5, coalesce(round(1.0 / k, 4), 0.0) AS mrr, CASE WHEN k IS NULL THEN '' ELSE name END AS matched_terms FROM f""",
    "method_summary": f"SELECT event_type AS method, count(*) AS n, round(avg({_UNIT('value')}), 4) AS faithfulness, round(avg({_UNIT('(value / 10)')}), 4) AS relevance FROM events GROUP BY 1",
    "verdicts": f"""SELECT CASE WHEN {_UNIT("value")} < 0.5 THEN 'fail' WHEN {_UNIT("(value / 10)")} >= 0.75 THEN 'pass' WHEN {_UNIT("(value / 10)")} >= 0.5 THEN 'borderline' ELSE 'fail' END AS verdict, count(*) AS n FROM events GROUP BY 1""",
    "context_assembly": BASE + """, l AS (SELECT r.subject_entity_id AS entity_id, r.relation_id, r.confidence, '- ' || coalesce(s.name, '') || ' --' || r.relation_type || '--> ' || coalesce(o.name, '') AS line FROM rel r JOIN ent s ON s.entity_id = r.subject_entity_id JOIN ent o ON o.entity_id = r.object_entity_id),
k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, relation_id) AS rank FROM l)
SELECT entity_id, string_agg(line, chr(10) ORDER BY rank) AS context FROM k WHERE rank <= 5 GROUP BY entity_id""",
    "ingest_summary": BASE + """, p AS (SELECT article_id, count(*) AS n_chunks, sum(coalesce(token_count, 0)) AS n_tokens FROM ch GROUP BY article_id)
SELECT a.source, count(*) AS n_articles, sum(coalesce(p.n_chunks, 0)) AS n_chunks, sum(coalesce(p.n_tokens, 0)) AS n_tokens, count(*) FILTER (p.n_chunks IS NULL) AS without_chunks FROM art a LEFT JOIN p USING (article_id) GROUP BY a.source""",
}
