"""Graph queries over entities, relations, chunks and articles, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phloem.operators import graph as g
from phloem.operators import merge
from phloem.operators import rank as r
from phloem.storage import Stage, table

#: A batch of questions as the retrieval queries get it.
QUESTIONS = (("q1", "viêm da"), ("q2", "thoái hóa"), ("q3", "ho khan"), ("q4", "dị ứng vùng cổ"), ("q5", "chóng mặt"))
#: An entity without a profile text has its description as one, so the SQL counts a description for both.
_ENTITY_WEIGHTS = {"name": 4, "normalized_name": 4, "aliases": 3, "surface_forms": 3, "description": 2, "profile_text": 2}
_SEED_WEIGHTS = {"name": 5, "normalized_name": 5, "aliases": 4, "surface_forms": 4, "description": 2, "profile_text": 2}
_RELATION_WEIGHTS = {
    "relation_type": 2, "description": 4, "evidence_text": 3, "keywords": 4, "subject_name": 3, "object_name": 3,
    "subject_aliases": 2, "object_aliases": 2, "subject_surface_forms": 2, "object_surface_forms": 2,
}
_SEEDS, _ITERATIONS = 12, 5


class Graph:
    """The current graph of a table folder; ``fixed`` writes its tables once, for queries that read them several times."""

    def __init__(self, spark: SparkSession, sf_dir: str, fixed: bool = False):
        self.spark = spark
        read = lambda t: table(spark, sf_dir, t)
        self.raw = {t: read(t) for t in ("entities", "relations", "chunks", "articles")}
        self.entities = g.current_entities(self.raw["entities"]).withColumn("profile_text", F.col("description"))
        self.chunks = g.current_chunks(self.raw["chunks"])
        self.articles = g.current_articles(self.raw["articles"])
        self.relations = g.merged_relations(self.raw["relations"], self.entities)
        self.links = g.evidence_links(self.raw["relations"]).join(self.relations.select("relation_id"), "relation_id", "left_semi")
        self.mentions = g.mentions(self.relations, self.links, self.chunks)
        self.stage = Stage(spark, "graph") if fixed else None
        self._seeds = None
        if self.stage:
            self.relations = self.stage.write(self.relations, "relations")
            self.links = self.stage.write(self.links, "links")
            self.mentions = self.stage.write(g.mentions(self.relations, self.links, self.chunks), "mentions")

    def questions(self) -> DataFrame:
        return self.spark.createDataFrame(QUESTIONS, "query_id string, text string")

    def seeds(self) -> DataFrame:
        if self._seeds is not None:
            return self._seeds
        scored = g.lexical_scores(self.questions(), self.entities, _SEED_WEIGHTS, "entity_id").join(self.entities.select("entity_id", F.coalesce("mention_count", F.lit(0)).alias("m")), "entity_id")
        found = g.top_per_query(scored, _SEEDS, F.desc("score"), F.desc("m"), F.asc("entity_id")).select("query_id", "entity_id", "score")
        if self.stage:
            found = self._seeds = self.stage.write(found, "seeds")
        return found

    def ranks(self) -> DataFrame:
        seeds = g.specificity(self.seeds(), g.document_frequency(self.mentions)).select("query_id", "entity_id", "score")
        edges = g.induced(self.relations, g.neighbourhood(self.relations, seeds, 2))
        return r.pagerank(seeds, edges, iterations=_ITERATIONS, tolerance=0)


def _lexical_entities(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    scored = g.lexical_scores(x.questions(), x.entities, _ENTITY_WEIGHTS, "entity_id").join(x.entities.select("entity_id", F.coalesce("mention_count", F.lit(0)).alias("mention_count")), "entity_id")
    return g.top_per_query(scored, 20, F.desc("score"), F.desc("mention_count"), F.asc("entity_id")).select("query_id", "entity_id", "score", "rank")


def relation_texts(x: Graph) -> DataFrame:
    """Relations with their ends' names and lists, and their own keywords."""
    rows = g.with_names(x.relations, x.entities, "aliases", "surface_forms")
    return rows.join(merge.set_union(x.raw["relations"], "relation_id", "keywords").select("relation_id", "keywords"), "relation_id", "left")


def _lexical_relations(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    scored = g.lexical_scores(x.questions(), relation_texts(x), _RELATION_WEIGHTS, "relation_id").join(x.relations.select("relation_id", "confidence"), "relation_id")
    return g.top_per_query(scored, 20, F.desc("score"), F.desc("confidence"), F.asc("relation_id")).select("query_id", "relation_id", "score", "rank")


def _seed_entities(spark: SparkSession, d: str) -> DataFrame:
    return Graph(spark, d).seeds()


def _entities_by_names(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    wanted = x.raw["chunks"].select(F.lower(F.trim("section")).alias("n")).union(x.raw["entities"].select(F.explode("surface_forms")).select(F.lower("col")))
    return g.lookup(x.entities.withColumn("lowered", F.lower("name")), "lowered", wanted.filter("n is not null")).select("entity_id", "name", "entity_type")


def _entities_of_types(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    some = g.optional_filter(x.entities, "entity_type", ["BENH_LY", "DOI_TUONG"]).groupBy("entity_type").agg(F.count("*").alias("n"))
    return some.unionByName(g.optional_filter(x.entities, "entity_type", None).agg(F.lit("any").alias("entity_type"), F.count("*").alias("n")))


def _chunks_by_entities(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    return g.chunks_of_entities(x.mentions, x.seeds())


def _neighbors(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    return g.neighbours(x.relations, x.seeds())


def _synonym_neighbors(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    return g.synonym_neighbours(x.relations, x.entities, x.seeds())


def _relations_touching(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    return g.relations_touching(x.relations, x.seeds()).select("query_id", "relation_id", "subject_entity_id", "object_entity_id", "relation_type", "confidence")


def _relation_views(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    end = lambda p: x.entities.select(F.col("entity_id").alias(f"{p}_entity_id"), F.col("name").alias(f"{p}_name"), F.col("entity_type").alias(f"{p}_type"))
    return x.relations.join(end("subject"), "subject_entity_id").join(end("object"), "object_entity_id").select("relation_id", "subject_name", "subject_type", "relation_type", "object_name", "object_type", "confidence")


def _evidence_chunks(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    return g.evidence_chunks(x.links, g.relations_touching(x.relations, x.seeds()), x.chunks)


def _mention_links(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    return x.mentions.join(x.entities.select("entity_id", "name", "entity_type"), "entity_id").select("chunk_id", "entity_id", "name", "entity_type", "confidence")


def _khop(hops: int):
    def query(spark: SparkSession, d: str) -> DataFrame:
        x = Graph(spark, d, fixed=True)
        return g.induced(x.relations, g.neighbourhood(x.relations, x.seeds(), hops))

    return query


def _adjacency(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    return x.relations.select("relation_id", F.col("subject_entity_id").alias("source_entity_id"), F.col("object_entity_id").alias("target_entity_id"), "relation_type", F.col("confidence").alias("weight"))


def _entity_evidence(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    texts = x.mentions.join(x.chunks.select("chunk_id", "text"), "chunk_id").filter("text <> ''").select("entity_id", "text").distinct()
    ranked = texts.withColumn("n", F.row_number().over(g.Window.partitionBy("entity_id").orderBy("text"))).filter("n <= 5")
    first = ranked.groupBy("entity_id").agg(F.count("*").alias("n_texts"), F.md5(F.array_join(F.array_sort(F.collect_list("text")), "|")).alias("texts"))
    return x.entities.select("entity_id").join(first, "entity_id", "left").select("entity_id", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), "texts")


def _graph_stats(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    return g.graph_stats(x.articles, x.chunks, x.entities, x.relations)


def _chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return g.document_frequency(Graph(spark, d).mentions)


def _node_specificity(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    return g.specificity(x.seeds(), g.document_frequency(x.mentions)).select("query_id", "entity_id", "specificity", "score")


def _endpoint_specificity(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    df = g.document_frequency(x.mentions)
    one = lambda c: df.select(F.col("entity_id").alias(c), (1 / F.col("n_chunks")).alias(f"s_{c}"))
    both = x.relations.join(one("subject_entity_id"), "subject_entity_id", "left").join(one("object_entity_id"), "object_entity_id", "left")
    value = F.greatest(F.coalesce("s_subject_entity_id", F.lit(1.0)), F.coalesce("s_object_entity_id", F.lit(1.0)))
    return both.select("relation_id", F.round(F.col("confidence") * value, 9).alias("score"))


def _has_chunk(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    return x.chunks.select("chunk_id", "article_id").join(x.articles.select("article_id"), "article_id").select("article_id", "chunk_id")


def _pagerank(spark: SparkSession, d: str) -> DataFrame:
    return Graph(spark, d, fixed=True).ranks().select("query_id", "entity_id", F.round("score", 8).alias("score"))


def _hippo_relations(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d, fixed=True)
    return r.relation_scores(g.relations_touching(x.relations, x.seeds()), x.ranks()).select("query_id", "relation_id", F.round("score", 8).alias("score"))


def _hippo_chunks(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d, fixed=True)
    ranks = x.ranks()
    scored = r.relation_scores(g.relations_touching(x.relations, x.seeds()), ranks)
    return r.chunk_scores(x.mentions, ranks, scored, x.links).join(x.chunks.select("chunk_id"), "chunk_id", "left_semi").select("query_id", "chunk_id", F.round("score", 7).alias("score"))


def _branches(x: Graph) -> DataFrame:
    """Three branches of chunk results for each question: by mentions, by evidence and by text."""
    seeds = x.seeds()
    a = g.chunks_of_entities(x.mentions, seeds).select("query_id", "chunk_id", F.col("score").cast("double").alias("score"), F.lit("graph").alias("branch"))
    b = g.evidence_chunks(x.links, g.relations_touching(x.relations, seeds), x.chunks).select("query_id", "chunk_id", (F.col("score") / 2.0).alias("score"), F.lit("light").alias("branch"))
    c = g.lexical_scores(x.questions(), x.chunks, {"title": 4, "section": 2, "text": 3}, "chunk_id").select("query_id", "chunk_id", F.col("score").cast("double").alias("score"), F.lit("text").alias("branch"))
    return a.unionByName(b).unionByName(c)


def _rrf(spark: SparkSession, d: str) -> DataFrame:
    fused = r.reciprocal_rank_fusion(_branches(Graph(spark, d, fixed=True)), "chunk_id")
    return fused.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.array_join("branches", ",").alias("branches"), "best_score")


def _max_merge(spark: SparkSession, d: str) -> DataFrame:
    return r.max_merge(_branches(Graph(spark, d, fixed=True)), "chunk_id").select("query_id", "chunk_id", "branch", "score")


def _seed_merge(spark: SparkSession, d: str) -> DataFrame:
    """Seeds by text and by neighbourhood, the larger score of each, normalised."""
    x = Graph(spark, d)
    both = x.seeds().select("query_id", "entity_id", F.col("score").cast("double").alias("score")).unionByName(g.neighbours(x.relations, x.seeds()).select("query_id", "entity_id", F.col("score").cast("double").alias("score")))
    return r.normalized(both.groupBy("query_id", "entity_id").agg(F.max("score").alias("score"))).select("query_id", "entity_id", F.round("score", 9).alias("score"))


def _filter_fallback(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    touching = g.relations_touching(x.relations, x.seeds()).withColumn("keep", F.col("relation_type").isin("GAY_BIEN_CHUNG", "CAN_TRANH") & (F.col("confidence") > 0.9))
    return r.filter_or_all(touching, "keep").select("query_id", "relation_id")


def _diseases(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d, fixed=True)
    touching = g.relations_touching(x.relations, x.seeds()).withColumn("score", F.col("confidence"))
    return r.disease_candidates(touching, x.entities, x.seeds()).select("query_id", "entity_id", F.round("score", 8).alias("score"))


def _disease_chunk_boost(spark: SparkSession, d: str) -> DataFrame:
    """What disease candidates add to the chunks that are evidence of their relations."""
    x = Graph(spark, d, fixed=True)
    touching = g.relations_touching(x.relations, x.seeds()).withColumn("score", F.col("confidence"))
    scores = r.disease_candidates(touching, x.entities, x.seeds())
    kinds = x.entities.select("entity_id", "entity_type")
    ends = touching.join(kinds.select(F.col("entity_id").alias("subject_entity_id"), F.col("entity_type").alias("s")), "subject_entity_id")
    ends = ends.withColumn("entity_id", F.when(F.col("s") == "BENH_LY", F.col("subject_entity_id")).otherwise(F.col("object_entity_id")))
    boosted = ends.select("query_id", "relation_id", "entity_id").join(scores, ["query_id", "entity_id"]).join(x.links, "relation_id")
    return boosted.groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 6).alias("boost"))


def _duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return g.unique_violations(table(spark, d, "relations"), "relation_id").select("relation_id", "n")


QUERIES = {
    "lexical_entities": _lexical_entities, "lexical_relations": _lexical_relations, "seed_entities": _seed_entities, "entities_by_names": _entities_by_names,
    "entities_of_types": _entities_of_types, "chunks_by_entities": _chunks_by_entities, "neighbors": _neighbors, "synonym_neighbors": _synonym_neighbors,
    "relations_touching": _relations_touching, "relation_views": _relation_views, "evidence_chunks": _evidence_chunks, "mention_links": _mention_links,
    "khop_1": _khop(1), "khop_2": _khop(2), "khop_3": _khop(3), "adjacency": _adjacency, "entity_evidence": _entity_evidence, "graph_stats": _graph_stats,
    "entity_chunk_counts": _chunk_counts, "node_specificity": _node_specificity, "endpoint_specificity": _endpoint_specificity, "has_chunk": _has_chunk,
    "pagerank": _pagerank, "hippo_relations": _hippo_relations, "hippo_chunks": _hippo_chunks, "rrf_fuse": _rrf, "max_merge": _max_merge, "seed_merge": _seed_merge,
    "relation_filter_fallback": _filter_fallback, "disease_candidates": _diseases, "disease_chunk_boost": _disease_chunk_boost, "duplicate_keys": _duplicate_keys,
}


def _latest(name: str, key: str, ties: str) -> str:
    return f"(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ingested_at DESC NULLS LAST, {ties}) AS rn FROM {name} WHERE deleted_at IS NULL AND {key} IS NOT NULL) WHERE rn = 1)"


def _has(field: str, is_list: bool = False) -> str:
    if is_list:
        return f"len(list_filter(coalesce({field}, []), lambda z: contains(lower(z), lower(trim(q.text))))) > 0"
    return f"contains(lower(coalesce({field}, '')), lower(trim(q.text)))"


def _score(weights: dict[str, int], prefix: str = "") -> str:
    fields = {f: w for f, w in weights.items() if f != "profile_text"}
    if "profile_text" in weights:
        fields["description"] += weights["profile_text"]
    return " + ".join(f"CASE WHEN {_has(prefix + f, f.endswith(('aliases', 'surface_forms', 'keywords')))} THEN {w} ELSE 0 END" for f, w in fields.items())


BASE = f"""
WITH questions(query_id, text) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in QUESTIONS)}),
ent AS MATERIALIZED {_latest("entities", "entity_id", "name NULLS FIRST, mention_count NULLS FIRST")},
ch AS MATERIALIZED {_latest("chunks", "chunk_id", "text NULLS FIRST, token_count NULLS FIRST")},
art AS {_latest("articles", "article_id", "body NULLS FIRST, url NULLS FIRST")},
rel0 AS (
  SELECT relation_id, min(subject_entity_id) AS subject_entity_id, min(object_entity_id) AS object_entity_id, min(upper(trim(relation_type))) AS relation_type,
    coalesce(max(CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END), 1.0) AS confidence,
    arg_min(description, struct_pack(i := ingested_at, t := description)) FILTER (trim(coalesce(description, '')) <> '') AS description,
    arg_min(evidence_text, struct_pack(i := ingested_at, t := evidence_text)) FILTER (trim(coalesce(evidence_text, '')) <> '') AS evidence_text
  FROM relations WHERE relation_id IS NOT NULL GROUP BY relation_id
),
rel AS MATERIALIZED (SELECT * FROM rel0 WHERE subject_entity_id IN (SELECT entity_id FROM ent) AND object_entity_id IN (SELECT entity_id FROM ent)),
ev AS MATERIALIZED (
  SELECT DISTINCT relation_id, chunk_id FROM (SELECT relation_id, regexp_replace(c, '^\\s+|\\s+$', '', 'g') AS chunk_id FROM (SELECT relation_id, unnest(evidence_chunk_ids) AS c FROM relations))
  WHERE chunk_id <> '' AND relation_id IN (SELECT relation_id FROM rel)
),
men AS MATERIALIZED (
  SELECT chunk_id, entity_id, max(confidence) AS confidence
  FROM (SELECT chunk_id, subject_entity_id AS entity_id, confidence FROM ev JOIN rel USING (relation_id) UNION ALL SELECT chunk_id, object_entity_id, confidence FROM ev JOIN rel USING (relation_id))
  WHERE chunk_id IN (SELECT chunk_id FROM ch) GROUP BY chunk_id, entity_id
),
sc AS (SELECT q.query_id, e.entity_id, {_score(_SEED_WEIGHTS, "e.")} AS score, coalesce(e.mention_count, 0) AS m FROM questions q, ent e),
seeds AS MATERIALIZED (SELECT query_id, entity_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, m DESC, entity_id) AS rn FROM sc WHERE score > 0) WHERE rn <= {_SEEDS}),
both_ways AS MATERIALIZED (
  SELECT relation_id, subject_entity_id AS entity_id, object_entity_id AS neighbour_id, relation_type, confidence FROM rel
  UNION ALL SELECT relation_id, object_entity_id, subject_entity_id, relation_type, confidence FROM rel WHERE subject_entity_id <> object_entity_id
),
touching AS MATERIALIZED (SELECT DISTINCT s.query_id, r.* FROM rel r JOIN seeds s ON s.entity_id = r.subject_entity_id OR s.entity_id = r.object_entity_id),
df AS (SELECT entity_id, count(*) AS n_chunks FROM men GROUP BY entity_id),
evc AS (SELECT t.query_id, ev.chunk_id, count(*) AS score FROM ev JOIN touching t USING (relation_id) WHERE ev.chunk_id IN (SELECT chunk_id FROM ch) GROUP BY ALL),
che AS (SELECT s.query_id, m.chunk_id, count(*) AS score FROM men m JOIN seeds s USING (entity_id) GROUP BY ALL),
nb AS (SELECT s.query_id, b.neighbour_id AS entity_id, count(*) AS score FROM both_ways b JOIN seeds s USING (entity_id) GROUP BY ALL)
"""


def _near(hops: int) -> str:
    out = "h0 AS (SELECT query_id, entity_id FROM seeds)"
    for i in range(1, hops + 1):
        out += f", h{i} AS MATERIALIZED (SELECT query_id, entity_id FROM h{i - 1} UNION SELECT h.query_id, b.neighbour_id FROM h{i - 1} h JOIN both_ways b USING (entity_id))"
    return out


def _induced(hops: int) -> str:
    return f"""SELECT a.query_id, r.relation_id, r.subject_entity_id AS source, r.object_entity_id AS target, r.confidence AS weight
FROM rel r JOIN h{hops} a ON a.entity_id = r.subject_entity_id JOIN h{hops} b ON b.entity_id = r.object_entity_id AND b.query_id = a.query_id"""


def _ppr() -> str:
    out = f""", {_near(2)}, edges AS ({_induced(2)} ),
pairs AS (SELECT query_id, source, target, weight FROM edges WHERE weight > 0 UNION ALL SELECT query_id, target, source, weight FROM edges WHERE weight > 0),
summed AS (SELECT query_id, source, target, sum(weight) AS weight FROM pairs GROUP BY ALL),
steps AS MATERIALIZED (SELECT query_id, source, target, weight / sum(weight) OVER (PARTITION BY query_id, source) AS part FROM summed),
adj AS (SELECT s.query_id, s.entity_id, s.score / greatest(coalesce(d.n_chunks, 1), 1) AS score FROM seeds s LEFT JOIN df d USING (entity_id)),
p AS MATERIALIZED (SELECT query_id, entity_id, score / sum(score) OVER (PARTITION BY query_id) AS p FROM adj WHERE score > 0),
r0 AS (SELECT query_id, entity_id, p AS score FROM p)"""
    for i in range(1, _ITERATIONS + 1):
        out += f""",
r{i} AS MATERIALIZED (
  SELECT query_id, entity_id, sum(score) AS score FROM (
    SELECT s.query_id, s.target AS entity_id, 0.85 * s.part * r.score AS score FROM steps s JOIN r{i - 1} r ON r.query_id = s.query_id AND r.entity_id = s.source
    UNION ALL
    SELECT p.query_id, p.entity_id, p.p * (0.15 + 0.85 * coalesce((SELECT sum(r.score) FROM r{i - 1} r WHERE r.query_id = p.query_id AND NOT EXISTS (SELECT 1 FROM steps s WHERE s.query_id = r.query_id AND s.source = r.entity_id)), 0)) FROM p
  ) GROUP BY query_id, entity_id
)"""
    return out + f", rk AS (SELECT * FROM r{_ITERATIONS} WHERE score > 0)"


RELATION_TEXTS = """kw AS (SELECT relation_id, list(DISTINCT k) AS keywords FROM (SELECT relation_id, unnest(keywords) AS k FROM relations) WHERE trim(k) <> '' GROUP BY relation_id),
v AS MATERIALIZED (
  SELECT r.*, kw.keywords, s.name AS subject_name, o.name AS object_name, s.entity_type AS subject_type, o.entity_type AS object_type,
    s.aliases AS subject_aliases, o.aliases AS object_aliases, s.surface_forms AS subject_surface_forms, o.surface_forms AS object_surface_forms
  FROM rel r JOIN ent s ON s.entity_id = r.subject_entity_id JOIN ent o ON o.entity_id = r.object_entity_id LEFT JOIN kw USING (relation_id)
)"""
_RELSCORE = """, rs AS (
  SELECT t.*, greatest(coalesce(a.score, 0), coalesce(b.score, 0)) * t.confidence AS score
  FROM touching t LEFT JOIN rk a ON a.query_id = t.query_id AND a.entity_id = t.subject_entity_id LEFT JOIN rk b ON b.query_id = t.query_id AND b.entity_id = t.object_entity_id
)"""
_BRANCHES = f""", br AS MATERIALIZED (
  SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, 'graph' AS branch FROM che
  UNION ALL SELECT query_id, chunk_id, score / 2.0, 'light' FROM evc
  UNION ALL SELECT * FROM (SELECT q.query_id, c.chunk_id, CAST({_score({"title": 4, "section": 2, "text": 3}, "c.")} AS DOUBLE) AS score, 'text' FROM questions q, ch c) WHERE score > 0
)"""
_CANDIDATES = """, typed AS (
  SELECT t.*, s.entity_type AS st, o.entity_type AS ot,
    CASE t.relation_type WHEN 'CO_BIEU_HIEN' THEN 2.4 WHEN 'LIEN_QUAN_YEU_TO' THEN 1.2 WHEN 'ANH_HUONG_DEN' THEN 0.8 WHEN 'CHAN_DOAN_PHAN_BIET_VOI' THEN 0.6 END AS w
  FROM touching t JOIN ent s ON s.entity_id = t.subject_entity_id JOIN ent o ON o.entity_id = t.object_entity_id
), picked AS (
  SELECT query_id, CASE WHEN st = 'BENH_LY' THEN subject_entity_id ELSE object_entity_id END AS entity_id, CASE WHEN st = 'BENH_LY' THEN object_entity_id ELSE subject_entity_id END AS far, confidence, w
  FROM typed WHERE w IS NOT NULL AND (st = 'BENH_LY' OR ot = 'BENH_LY')
), cand AS (
  SELECT p.query_id, p.entity_id, CAST(sum(greatest(p.confidence, 0.05) * p.w * CASE WHEN s.entity_id IS NULL THEN 0.65 ELSE 1.8 END) * (1 + least(count(*), 4) * 0.12) AS DOUBLE) AS score
  FROM picked p LEFT JOIN seeds s ON s.query_id = p.query_id AND s.entity_id = p.far GROUP BY p.query_id, p.entity_id
)"""

SQL = {
    "lexical_entities": BASE + f""", x AS (SELECT q.query_id, e.entity_id, {_score(_ENTITY_WEIGHTS, "e.")} AS score, coalesce(e.mention_count, 0) AS m FROM questions q, ent e)
SELECT query_id, entity_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, m DESC, entity_id) AS rank FROM x WHERE score > 0) WHERE rank <= 20""",
    "lexical_relations": BASE + f""", {RELATION_TEXTS},
x AS (SELECT q.query_id, v.relation_id, v.confidence, {_score(_RELATION_WEIGHTS, "v.")} AS score FROM questions q, v)
SELECT query_id, relation_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, confidence DESC, relation_id) AS rank FROM x WHERE score > 0) WHERE rank <= 20""",
    "seed_entities": BASE + "SELECT query_id, entity_id, score FROM seeds",
    "entities_by_names": BASE + """, w AS (SELECT lower(trim(section)) AS n FROM chunks UNION SELECT lower(f) FROM (SELECT unnest(surface_forms) AS f FROM entities))
SELECT entity_id, name, entity_type FROM ent WHERE lower(name) IN (SELECT n FROM w WHERE n IS NOT NULL)""",
    "entities_of_types": BASE + """SELECT entity_type, count(*) AS n FROM ent WHERE entity_type IN ('BENH_LY', 'DOI_TUONG') GROUP BY entity_type UNION ALL SELECT 'any', count(*) FROM ent""",
    "chunks_by_entities": BASE + "SELECT * FROM che",
    "neighbors": BASE + "SELECT * FROM nb",
    "synonym_neighbors": BASE + """SELECT s.query_id, n.entity_id, max(b.confidence) AS score, max(coalesce(n.mention_count, 0)) AS mention_count
FROM both_ways b JOIN seeds s USING (entity_id) JOIN ent e ON e.entity_id = s.entity_id JOIN ent n ON n.entity_id = b.neighbour_id AND n.entity_type = e.entity_type
WHERE b.relation_type = 'DONG_NGHIA_VOI' GROUP BY s.query_id, n.entity_id""",
    "relations_touching": BASE + "SELECT query_id, relation_id, subject_entity_id, object_entity_id, relation_type, confidence FROM touching",
    "relation_views": BASE + """SELECT r.relation_id, s.name AS subject_name, s.entity_type AS subject_type, r.relation_type, o.name AS object_name, o.entity_type AS object_type, r.confidence
FROM rel r JOIN ent s ON s.entity_id = r.subject_entity_id JOIN ent o ON o.entity_id = r.object_entity_id""",
    "evidence_chunks": BASE + "SELECT * FROM evc",
    "mention_links": BASE + "SELECT m.chunk_id, m.entity_id, e.name, e.entity_type, m.confidence FROM men m JOIN ent e USING (entity_id)",
    **{f"khop_{n}": BASE + f", {_near(n)} {_induced(n)}" for n in (1, 2, 3)},
    "adjacency": BASE + "SELECT relation_id, subject_entity_id AS source_entity_id, object_entity_id AS target_entity_id, relation_type, confidence AS weight FROM rel",
    "entity_evidence": BASE + """, t AS (SELECT DISTINCT m.entity_id, c.text FROM men m JOIN ch c USING (chunk_id) WHERE c.text <> ''),
f AS (SELECT entity_id, text FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY text) AS n FROM t) WHERE n <= 5),
a AS (SELECT entity_id, count(*) AS n_texts, md5(string_agg(text, '|' ORDER BY text)) AS texts FROM f GROUP BY entity_id)
SELECT e.entity_id, coalesce(a.n_texts, 0) AS n_texts, a.texts FROM ent e LEFT JOIN a USING (entity_id)""",
    "graph_stats": BASE + "SELECT (SELECT count(*) FROM art) AS articles, (SELECT count(*) FROM ch) AS chunks, (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM rel) AS relations",
    "entity_chunk_counts": BASE + "SELECT entity_id, n_chunks FROM df",
    "node_specificity": BASE + "SELECT s.query_id, s.entity_id, greatest(1.0 / greatest(coalesce(d.n_chunks, 1), 1), 1e-6) AS specificity, s.score * greatest(1.0 / greatest(coalesce(d.n_chunks, 1), 1), 1e-6) AS score FROM seeds s LEFT JOIN df d USING (entity_id)",
    "endpoint_specificity": BASE + """SELECT r.relation_id, round(r.confidence * greatest(coalesce(1.0 / a.n_chunks, 1.0), coalesce(1.0 / b.n_chunks, 1.0)), 9) AS score
FROM rel r LEFT JOIN df a ON a.entity_id = r.subject_entity_id LEFT JOIN df b ON b.entity_id = r.object_entity_id""",
    "has_chunk": BASE + "SELECT a.article_id, c.chunk_id FROM ch c JOIN art a USING (article_id)",
    "pagerank": BASE + _ppr() + " SELECT query_id, entity_id, round(score, 8) AS score FROM rk",
    "hippo_relations": BASE + _ppr() + _RELSCORE + " SELECT query_id, relation_id, round(score, 8) AS score FROM rs",
    "hippo_chunks": BASE + _ppr() + _RELSCORE + """, parts AS (
  SELECT k.query_id, m.chunk_id, k.score * m.confidence AS score FROM men m JOIN rk k USING (entity_id)
  UNION ALL SELECT rs.query_id, ev.chunk_id, rs.score FROM ev JOIN rs USING (relation_id) WHERE rs.score > 0
) SELECT query_id, chunk_id, round(sum(score), 7) AS score FROM parts WHERE chunk_id IN (SELECT chunk_id FROM ch) GROUP BY ALL""",
    "rrf_fuse": BASE + _BRANCHES + """, rr AS (SELECT *, row_number() OVER (PARTITION BY query_id, branch ORDER BY score DESC, chunk_id) AS rn FROM br)
SELECT query_id, chunk_id, round(sum(1.0 / (60 + rn)), 9) AS score, string_agg(DISTINCT branch, ',' ORDER BY branch) AS branches, max(score) AS best_score FROM rr GROUP BY query_id, chunk_id""",
    "max_merge": BASE + _BRANCHES + "SELECT query_id, chunk_id, branch, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, branch) AS rn FROM br) WHERE rn = 1",
    "seed_merge": BASE + """, u AS (SELECT query_id, entity_id, max(score) AS score FROM (SELECT query_id, entity_id, CAST(score AS DOUBLE) AS score FROM seeds UNION ALL SELECT query_id, entity_id, CAST(score AS DOUBLE) FROM nb) GROUP BY ALL)
SELECT query_id, entity_id, round(score / sum(score) OVER (PARTITION BY query_id), 9) AS score FROM u""",
    "relation_filter_fallback": BASE + """, f AS (SELECT *, relation_type IN ('GAY_BIEN_CHUNG', 'CAN_TRANH') AND confidence > 0.9 AS keep FROM touching)
SELECT query_id, relation_id FROM (SELECT *, bool_or(keep) OVER (PARTITION BY query_id) AS any_kept FROM f) WHERE keep OR NOT any_kept""",
    "disease_candidates": BASE + _CANDIDATES + " SELECT query_id, entity_id, round(score, 8) AS score FROM cand",
    "disease_chunk_boost": BASE + _CANDIDATES + """, ends AS (SELECT t.query_id, t.relation_id, CASE WHEN s.entity_type = 'BENH_LY' THEN t.subject_entity_id ELSE t.object_entity_id END AS entity_id FROM touching t JOIN ent s ON s.entity_id = t.subject_entity_id)
SELECT e.query_id, ev.chunk_id, round(sum(c.score), 6) AS boost FROM ends e JOIN cand c USING (query_id, entity_id) JOIN ev USING (relation_id) GROUP BY ALL""",
    "duplicate_keys": "SELECT relation_id, count(*) AS n FROM relations GROUP BY relation_id HAVING count(*) > 1",
}
