"""Composed retrieval over the built-in questions and a few short ones, and its SQL.

Vectors of questions are replayed: the n-th question has the vector of the n-th entity that has one, by id. Hits of
relations are lexical, as the tables have no relation vectors. PageRank runs a fixed number of iterations here, which SQL
can unroll; ``hippo_settled`` runs to the tolerance.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phloem.operators import graph as g
from phloem.plans import evaluate, keywords, models, retrieve
from phloem.plans.questions import QUESTIONS, built_in
from phloem.queries.graph import _CANDIDATES, _ENTITY_WEIGHTS, _RELATION_WEIGHTS, _SEED_WEIGHTS, BASE, RELATION_TEXTS, Graph, _score, relation_texts
from phloem.queries.graph import QUESTIONS as SHORT
from phloem.storage import table

_ITERATIONS = 5
FIXED = retrieve.Limits(iterations=_ITERATIONS, tolerance=0)
ASKED = (*((q[0], q[2]) for q in QUESTIONS), *SHORT)


class Retrieval(Graph):
    """The graph, the questions as they are understood, and the hits that the composed queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir, fixed=True)
        self.entities, self.chunks = self.stage.write(self.entities, "entities"), self.stage.write(self.chunks, "chunks")
        self.tables = retrieve.Tables(self.entities, self.relations, self.links, self.mentions, self.chunks)
        self.asked = self.stage.write(keywords.understood(spark.createDataFrame(ASKED, "query_id string, text string")), "asked")
        finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        points = table(spark, sf_dir, "vector_points").filter((F.size("vector") == 96) & finite & F.exists("vector", lambda v: v != 0))
        self.points = self.stage.write(points.select("payload.kind", "payload.ref_id", "vector").distinct(), "points")
        numbered = g.top_per_query(self.points.filter("kind = 'entity'").withColumn("query_id", F.lit(0)), len(ASKED), F.asc("ref_id"))
        names = self.asked.select("query_id").withColumn("rank", F.row_number().over(Window.orderBy("query_id")))  # one row a question
        self.vectors = self.stage.write(names.join(numbered.select("rank", "vector"), "rank").select("query_id", "vector"), "vectors")

    def vector_hits(self, kind: str, k: int) -> DataFrame:
        existing, key = (self.entities, "entity_id") if kind == "entity" else (self.chunks, "chunk_id")
        return retrieve.vector_hits(self.vectors, self.points, kind, existing, key, k)

    def relation_hits(self) -> DataFrame:
        texts = self.stage.write(relation_texts(self), "texts")
        both = retrieve.best([g.lexical_scores(self.asked.select("query_id", F.col(c).alias("text")), texts, _RELATION_WEIGHTS, "relation_id") for c in ("low_text", "high_text")], "relation_id")
        return retrieve.first(both, "relation_id", 20)

    def lexical_seeds(self) -> DataFrame:
        scored = g.lexical_scores(self.asked.select("query_id", F.col("low_text").alias("text")), self.entities, _SEED_WEIGHTS, "entity_id")
        ranked = scored.join(self.entities.select("entity_id", F.coalesce("mention_count", F.lit(0)).alias("m")), "entity_id")
        return g.top_per_query(ranked, 12, F.desc("score"), F.desc("m"), F.asc("entity_id")).select("query_id", "entity_id", "score")

    def light(self) -> dict[str, DataFrame]:
        return retrieve.light(self.tables, self.asked, self.vector_hits("entity", 20), self.relation_hits())

    def associative(self, limits: retrieve.Limits = FIXED) -> dict[str, DataFrame]:
        return retrieve.associative(self.tables, self.lexical_seeds(), self.vector_hits("entity", 12), limits)

    def mixed(self) -> DataFrame:
        branches = {"vector": self.vector_hits("chunk", 10), "light": self.light()["chunks"], "hippo": self.associative()["chunks"]}
        return self.stage.write(retrieve.mixed({k: v.withColumn("score", F.round("score", 9)) for k, v in branches.items()}), "mixed")


def _parts(found: dict[str, DataFrame]) -> DataFrame:
    """The parts of a result as rows: (query_id, part, id, score)."""
    each = [d.select("query_id", F.lit(part).alias("part"), F.col(d.columns[1]).alias("id"), F.round("score", 7).alias("score")) for part, d in found.items()]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def _query_keywords(spark: SparkSession, d: str) -> DataFrame:
    read = keywords.understood(spark.createDataFrame(ASKED, "query_id string, text string"))
    return read.select("query_id", *[F.array_join(c, "|").alias(c) for c in ("low", "high")], "low_text", "high_text", "intent", F.array_join("types", "|").alias("types"), F.array_join(keywords.keyword_union(F.col("high"), F.col("low")), "|").alias("united"))


def _vector_rag(spark: SparkSession, d: str) -> DataFrame:
    return Retrieval(spark, d).vector_hits("chunk", 10).withColumn("score", F.round("score", 7))


def _entity_expansion(spark: SparkSession, d: str) -> DataFrame:
    x = Retrieval(spark, d)
    return _parts(dict(zip(("entities", "relations", "chunks"), retrieve.expand_entities(x.tables, x.vector_hits("entity", 20), x.asked))))


def _relation_expansion(spark: SparkSession, d: str) -> DataFrame:
    x = Retrieval(spark, d)
    return _parts(dict(zip(("entities", "relations", "chunks"), retrieve.expand_relations(x.tables, x.stage.write(x.relation_hits(), "hits")))))


def _light(spark: SparkSession, d: str) -> DataFrame:
    return _parts(Retrieval(spark, d).light())


def _hippo(spark: SparkSession, d: str) -> DataFrame:
    return _parts(Retrieval(spark, d).associative())


def _hippo_settled(spark: SparkSession, d: str) -> DataFrame:
    return _parts(Retrieval(spark, d).associative(retrieve.Limits()))


def _hippo_support(spark: SparkSession, d: str) -> DataFrame:
    x = Retrieval(spark, d)
    found = x.associative()
    s = retrieve.support(x.tables, found["chunks"], found["entities"], found["relations"])
    return s.select("query_id", "chunk_id", F.array_join("entity_ids", ",").alias("entity_ids"), F.array_join("relation_ids", ",").alias("relation_ids"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    return Retrieval(spark, d).mixed().select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.array_join("branches", ",").alias("branches"), F.round("best_score", 6).alias("best_score"))


def _ranked(hits: DataFrame, key: str, n: int) -> DataFrame:
    return g.top_per_query(hits, n, F.round("score", 9).desc(), F.asc(key)).select("query_id", key, "rank")


def _light_context(spark: SparkSession, d: str) -> DataFrame:
    x = Retrieval(spark, d)
    found = x.light()
    entities = _ranked(found["entities"], "entity_id", 30).join(x.entities, "entity_id")
    relations = _ranked(found["relations"], "relation_id", 40).join(relation_texts(x), "relation_id")
    chunks = _ranked(found["chunks"], "chunk_id", 12).join(x.chunks, "chunk_id")
    return retrieve.context(x.asked, entities, relations, chunks).select("query_id", F.length("context").alias("n_chars"), F.md5("context").alias("context"))


def evidence(x: Retrieval) -> DataFrame:
    """(query_id, lines): the evidence that the answer to each question is given, from the mixed result."""
    chunks = _ranked(x.mixed(), "chunk_id", 8).join(x.chunks, "chunk_id").withColumn("line", retrieve.evidence_lines()).filter("line is not null")
    return retrieve.listed(chunks, F.col("line"), 8, "\n\n")


def _mixed_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence(Retrieval(spark, d)).select("query_id", F.length("lines").alias("n_chars"), F.md5("lines").alias("lines"))


def _echo():
    """A client that answers offline, from the prompt alone."""
    return lambda prompt: hashlib.md5(prompt.encode()).hexdigest()


def _answers(spark: SparkSession, d: str) -> DataFrame:
    x = Retrieval(spark, d)
    asked = x.asked.join(evidence(x), "query_id", "left").withColumn("prompt", models.answer_prompt(F.col("text"), F.col("lines")))
    return models.call(asked, "query_id", "prompt", _echo).select("query_id", "ok", "answer", "attempt")


def _retrieval_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the three methods over the built-in questions."""
    x = Retrieval(spark, d)
    methods = {"vector": x.vector_hits("chunk", 10), "lightrag": x.light()["chunks"], "hipporag": x.associative()["chunks"]}
    asked = built_in(spark)
    parts = []
    for name, hits in methods.items():
        texts = _ranked(hits.withColumn("score", F.round("score", 9)), "chunk_id", 10).join(x.chunks, "chunk_id").select("query_id", "rank", F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("title", "section", "text", "contextualized_text")]).alias("text"))
        parts.append(evaluate.retrieval_metrics(texts, asked.select("query_id", "terms")).withColumn("method", F.lit(name)))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("method", "query_id", "first_hit_rank", "hit_at_1", "hit_at_3", "hit_at_5", "mrr", F.array_join("matched_terms", "|").alias("matched_terms"))


def _compact(spark: SparkSession, d: str) -> DataFrame:
    """Each question's first ten entities and relations by name, and chunks by id."""
    x = Retrieval(spark, d)
    found = x.light()
    entities = retrieve.listed(_ranked(found["entities"], "entity_id", 10).join(x.entities, "entity_id"), F.coalesce("name", F.lit("")), 10, "|")
    named = g.with_names(x.relations, x.entities)
    relations = retrieve.listed(_ranked(found["relations"], "relation_id", 10).join(named, "relation_id"), F.concat(F.coalesce("subject_name", F.lit("")), F.lit(" -["), "relation_type", F.lit("]-> "), F.coalesce("object_name", F.lit(""))), 10, "|")
    chunks = retrieve.listed(_ranked(found["chunks"], "chunk_id", 10), F.col("chunk_id"), 10, "|")
    out = x.asked.select("query_id")
    for name, rows in (("entities", entities), ("relations", relations), ("chunks", chunks)):
        out = out.join(rows.withColumnRenamed("lines", name), "query_id", "left")
    return out


def _payload_hits(spark: SparkSession, d: str) -> DataFrame:
    """Vector hits as records: title from the payload, else the record's own name, tagged by the search that they come from."""
    x = Retrieval(spark, d)
    titles = table(spark, d, "vector_points").select("payload.ref_id", F.nullif(F.trim("payload.title"), F.lit("")).alias("title")).groupBy("ref_id").agg(F.min("title").alias("title"))
    own = x.entities.select(F.col("entity_id").alias("ref_id"), "name").unionByName(x.chunks.select(F.col("chunk_id").alias("ref_id"), F.col("title").alias("name")))
    hits = [x.vector_hits(kind, 5).toDF("query_id", "ref_id", "score").withColumn("source", F.lit(tag)) for kind, tag in (("entity", "lightrag_entity"), ("chunk", "vector_chunk"))]
    both = hits[0].unionByName(hits[1]).join(titles, "ref_id", "left").join(own, "ref_id", "left")
    return both.select("query_id", "source", "ref_id", F.coalesce("title", F.nullif("name", F.lit("")), "ref_id").alias("title"), F.round("score", 7).alias("score"))


QUERIES = {
    "compact_results": _compact, "payload_hits": _payload_hits, "query_keywords": _query_keywords, "vector_rag": _vector_rag, "entity_expansion": _entity_expansion, "relation_expansion": _relation_expansion, "lightrag": _light, "hipporag": _hippo,
    "hippo_settled": _hippo_settled, "hippo_support": _hippo_support, "mixed_rag": _mixed, "lightrag_context": _light_context, "mixed_evidence": _mixed_evidence, "answers": _answers, "retrieval_evaluation": _retrieval_evaluation,
}


# What the questions mean, worked out here again with Python's own patterns and folding for the SQL.


def _folded(text: str) -> str:
    import unicodedata

    plain = unicodedata.normalize("NFD", text.strip().lower().replace("đ", "d")).encode("ascii", "ignore").decode()
    return re.sub(r"[^a-z0-9]+", " ", plain).strip()


def _understood(question: str) -> dict:
    low_text = question.lower()
    high = [word for cues, word in keywords.KEYWORD_CUES if any(c in low_text for c in cues)] or ["thông tin y khoa"]
    text = question.strip(" ?!.。").lower()
    for words in keywords.ASIDE:
        text = re.sub(r"\b(" + "|".join(words) + r")\b", " ", text)
    parts = re.split(r"[,;:/]|" + "|".join(rf"\b{w}\b" for w in keywords.PARTING), " ".join(text.split()))
    low = [p.strip() for p in parts if 2 <= len(p.strip()) <= 80 and p.strip() not in high] or [question]
    cleaned: list[str] = []
    for w in low:
        w = " ".join(w.strip(" -–—:;,.()[]{}\n\t").split())
        if w and len(w.split()) <= 8 and w.lower() not in [c.lower() for c in cleaned] and len(cleaned) < 6:
            cleaned.append(w)
    low = [w for i, w in enumerate(cleaned) if len(_folded(w)) > 1 and _folded(w) not in [_folded(x) for x in cleaned[:i]]]
    said = _folded(" ".join([question, *low, *high]))
    intent = next((name for name, cues in keywords.INTENT_CUES if any(c in said for c in cues)), "general_fact")
    types = list(dict.fromkeys(k for cues, kinds in keywords.RELATION_CUES if any(c in said for c in cues) for k in kinds))
    if intent == "symptom_diagnosis":
        types = list(keywords.SYMPTOM_RELATIONS)
    high_text = keywords.SYMPTOM_TEXT if intent == "symptom_diagnosis" else "; ".join(high)
    return {"low": low, "high": high, "low_text": "; ".join(low) or question, "high_text": high_text, "intent": intent, "types": types}


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_READ = {i: _understood(q) for i, q in ASKED}
_VALUES = ", ".join(
    f"({_quoted(i)}, {_quoted(r['low_text'])}, {_quoted(r['high_text'])}, {_quoted(r['intent'])}, {'[' + ', '.join(map(_quoted, r['types'])) + ']' if r['types'] else 'NULL'}, {_quoted(', '.join(r['low']) or '(none)')}, {_quoted(', '.join(r['high']))})"
    for i, r in _READ.items()
)
_HITS = BASE + f""",
asked(query_id, low_text, high_text, intent, types, low_words, high_words) AS MATERIALIZED (VALUES {_VALUES}),
pts AS MATERIALIZED (
  SELECT DISTINCT payload.kind AS kind, payload.ref_id AS ref_id, CAST(vector AS DOUBLE[]) AS v FROM vector_points
  WHERE len(vector) = 96 AND len(list_filter(vector, lambda z: z IS NULL OR isnan(z) OR isinf(z))) = 0 AND len(list_filter(vector, lambda z: z <> 0)) > 0
),
qv AS MATERIALIZED (
  SELECT a.query_id, p.v FROM (SELECT query_id, row_number() OVER (ORDER BY query_id) AS n FROM asked) a
  JOIN (SELECT v, row_number() OVER (ORDER BY ref_id) AS n FROM pts WHERE kind = 'entity') p USING (n)
),
vh AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, ref_id) AS rn FROM (
    SELECT q.query_id, p.kind, p.ref_id, round(list_cosine_similarity(q.v, p.v), 9) AS score FROM qv q, pts p
    WHERE (p.kind = 'entity' AND p.ref_id IN (SELECT entity_id FROM ent)) OR (p.kind = 'chunk' AND p.ref_id IN (SELECT chunk_id FROM ch))
  )
),
eh AS MATERIALIZED (SELECT query_id, ref_id AS entity_id, score FROM vh WHERE kind = 'entity' AND rn <= 20),
{RELATION_TEXTS},
rx AS (
  SELECT query_id, relation_id, CAST(max(score) AS DOUBLE) AS score FROM (
    SELECT q.query_id, v.relation_id, {_score(_RELATION_WEIGHTS, "v.")} AS score FROM (SELECT query_id, low_text AS text FROM asked UNION ALL SELECT query_id, high_text FROM asked) q, v
  ) WHERE score > 0 GROUP BY query_id, relation_id
),
rh AS MATERIALIZED (SELECT query_id, relation_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, relation_id) AS rn FROM rx) WHERE rn <= 20)
"""


def _top(cte: str, key: str, n: int) -> str:
    return f"(SELECT query_id, {key}, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {key}) AS rn FROM {cte}) WHERE rn <= {n})"


def _touch(ids: str) -> str:
    return f"(SELECT i.query_id, r.relation_id, r.relation_type, r.confidence AS score FROM rel r JOIN {ids} i ON i.entity_id = r.subject_entity_id UNION SELECT i.query_id, r.relation_id, r.relation_type, r.confidence FROM rel r JOIN {ids} i ON i.entity_id = r.object_entity_id)"


def _evidence(relations: str) -> str:
    counted = f"(SELECT t.query_id, ev.chunk_id, count(*) AS score FROM ev JOIN {relations} t USING (relation_id) WHERE ev.chunk_id IN (SELECT chunk_id FROM ch) GROUP BY t.query_id, ev.chunk_id)"
    return _top(counted, "chunk_id", 50)


def _around(p: str, seeds: str) -> str:
    return f""",
{p}_syn AS (
  SELECT s.query_id, n.entity_id, max(b.confidence) AS score, max(coalesce(n.mention_count, 0)) AS m
  FROM both_ways b JOIN {seeds} s USING (entity_id) JOIN ent e ON e.entity_id = s.entity_id JOIN ent n ON n.entity_id = b.neighbour_id AND n.entity_type = e.entity_type
  WHERE b.relation_type = 'DONG_NGHIA_VOI' GROUP BY s.query_id, n.entity_id
),
{p}_ids AS MATERIALIZED (
  SELECT query_id, entity_id FROM {seeds}
  UNION SELECT query_id, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, m DESC, entity_id) AS rn FROM {p}_syn) WHERE rn <= 30
),
{p}_ent AS MATERIALIZED (SELECT query_id, entity_id, CAST(1 AS DOUBLE) AS score FROM {p}_ids WHERE entity_id IN (SELECT entity_id FROM ent)),
{p}_near AS MATERIALIZED (SELECT t.* FROM {_touch(p + "_ids")} t JOIN asked a USING (query_id) WHERE a.types IS NULL OR list_contains(a.types, t.relation_type)),
{p}_rel AS MATERIALIZED (SELECT * FROM {_top(p + "_near", "relation_id", 80)}),
{p}_ch AS MATERIALIZED (SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score FROM {_evidence(p + "_rel")})"""


def _from_relations(p: str, hits: str) -> str:
    return f""",
{p}_own AS MATERIALIZED (SELECT DISTINCT h.query_id, r.relation_id, r.subject_entity_id, r.object_entity_id, r.confidence AS score FROM {hits} h JOIN rel r USING (relation_id)),
{p}_ent AS MATERIALIZED (SELECT query_id, entity_id, CAST(1 AS DOUBLE) AS score FROM (SELECT query_id, subject_entity_id AS entity_id FROM {p}_own UNION SELECT query_id, object_entity_id FROM {p}_own) WHERE entity_id IN (SELECT entity_id FROM ent)),
{p}_near AS MATERIALIZED (SELECT * FROM {_touch(p + "_ent")}),
{p}_rel AS MATERIALIZED (SELECT query_id, relation_id, max(score) AS score FROM (SELECT query_id, relation_id, score FROM {p}_own UNION ALL SELECT * FROM {_top(p + "_near", "relation_id", 80)}) GROUP BY query_id, relation_id),
{p}_ch AS MATERIALIZED (SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score FROM {_evidence(p + "_own")})"""


def _best(key: str, *ctes: str) -> str:
    return f"(SELECT query_id, {key}, max(score) AS score FROM ({' UNION ALL '.join(f'SELECT query_id, {key}, CAST(score AS DOUBLE) AS score FROM {c}' for c in ctes)}) GROUP BY query_id, {key})"


def _show(**parts: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT query_id, '{p}' AS part, {key} AS id, round(score, 7) AS score FROM {cte}" for p, (cte, key) in parts.items())


_SPEC = "greatest(1.0 / greatest(coalesce({0}.n_chunks, 1), 1), 1e-6)"
_FOLD = "trim(regexp_replace(regexp_replace(replace(strip_accents(lower({0})), 'đ', 'd'), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_LIGHT = (
    _HITS
    + f""",
ls AS MATERIALIZED (SELECT e.query_id, e.entity_id, e.score * {_SPEC.format("d")} AS score FROM eh e LEFT JOIN df d USING (entity_id)),
ty AS (
  SELECT h.query_id, h.relation_id, h.score, r.subject_entity_id, r.object_entity_id,
    (h.query_id, r.subject_entity_id) IN (SELECT (query_id, entity_id) FROM ls) OR (h.query_id, r.object_entity_id) IN (SELECT (query_id, entity_id) FROM ls) AS keep
  FROM rh h JOIN rel r USING (relation_id) JOIN asked a USING (query_id) WHERE a.types IS NULL OR list_contains(a.types, r.relation_type)
),
fl AS (SELECT * FROM (SELECT *, bool_or(keep) OVER (PARTITION BY query_id) AS any_kept FROM ty) WHERE keep OR NOT any_kept),
lh AS MATERIALIZED (
  SELECT f.query_id, f.relation_id, f.score * greatest({_SPEC.format("a")}, {_SPEC.format("b")}) AS score
  FROM fl f LEFT JOIN df a ON a.entity_id = f.subject_entity_id LEFT JOIN df b ON b.entity_id = f.object_entity_id
)"""
    + _around("la", "ls")
    + _from_relations("lb", "lh")
    + f""",
lbase AS MATERIALIZED (SELECT * FROM {_best("relation_id", "lh", "la_rel", "lb_rel")})"""
    + _CANDIDATES.replace("t.*, s.entity_type", "t.query_id, t.relation_id, r.subject_entity_id, r.object_entity_id, t.score AS confidence, s.entity_type")
    .replace("CASE t.relation_type", "CASE r.relation_type")
    .replace("FROM touching t JOIN ent s ON s.entity_id = t.subject_entity_id JOIN ent o ON o.entity_id = t.object_entity_id", "FROM lbase t JOIN asked q USING (query_id) JOIN rel r USING (relation_id) JOIN ent s ON s.entity_id = r.subject_entity_id JOIN ent o ON o.entity_id = r.object_entity_id WHERE q.intent = 'symptom_diagnosis'")
    .replace("LEFT JOIN seeds s", "LEFT JOIN ls s")
    + f""",
lcand AS MATERIALIZED (SELECT * FROM cand),
ltop AS MATERIALIZED (SELECT * FROM {_top("lcand", "entity_id", 8)})"""
    + _around("lc", "ltop")
    + f""",
lrel AS MATERIALIZED (SELECT * FROM {_best("relation_id", "lbase", "lc_rel")}),
lown AS MATERIALIZED (
  SELECT x.query_id, x.relation_id, coalesce(a.entity_id, b.entity_id) AS entity_id, coalesce(a.score, b.score) AS score
  FROM lrel x JOIN rel r USING (relation_id) JOIN ent s ON s.entity_id = r.subject_entity_id JOIN ent o ON o.entity_id = r.object_entity_id
  LEFT JOIN lcand a ON a.query_id = x.query_id AND a.entity_id = r.subject_entity_id AND s.entity_type = 'BENH_LY'
  LEFT JOIN lcand b ON b.query_id = x.query_id AND b.entity_id = r.object_entity_id AND o.entity_type = 'BENH_LY'
  WHERE coalesce(a.entity_id, b.entity_id) IS NOT NULL
),
lev AS (SELECT o.query_id, ev.chunk_id, sum(o.score) AS boost FROM lown o JOIN ev USING (relation_id) GROUP BY o.query_id, ev.chunk_id),
lnames AS MATERIALIZED (SELECT DISTINCT o.query_id, o.entity_id, {_FOLD.format("e.name")} AS name, o.score FROM lown o JOIN ent e USING (entity_id)),
lch0 AS MATERIALIZED (SELECT * FROM {_best("chunk_id", "la_ch", "lb_ch", "lc_ch")}),
lnb AS (
  SELECT h.query_id, h.chunk_id, sum(n.score) * 0.35 AS boost FROM lch0 h JOIN ch c USING (chunk_id) JOIN lnames n ON n.query_id = h.query_id
  WHERE n.name <> '' AND contains({_FOLD.format("concat_ws(' ', c.title, c.section, substring(c.text, 1, 800))")}, n.name) GROUP BY h.query_id, h.chunk_id
),
lch AS MATERIALIZED (SELECT h.query_id, h.chunk_id, h.score + coalesce(a.boost, 0) + coalesce(b.boost, 0) AS score FROM lch0 h LEFT JOIN lev a USING (query_id, chunk_id) LEFT JOIN lnb b USING (query_id, chunk_id)),
lent AS MATERIALIZED (SELECT * FROM {_best("entity_id", "ls", "la_ent", "lb_ent", "lc_ent")}),
o_ent AS MATERIALIZED (SELECT * FROM {_top("lent", "entity_id", 30)}), o_rel AS MATERIALIZED (SELECT * FROM {_top("lrel", "relation_id", 40)}), o_ch AS MATERIALIZED (SELECT * FROM {_top("lch", "chunk_id", 12)})
"""
)


def _walk() -> str:
    out = f""",
hl AS (SELECT q.query_id, e.entity_id, {_score(_SEED_WEIGHTS, "e.")} AS score, coalesce(e.mention_count, 0) AS m FROM (SELECT query_id, low_text AS text FROM asked) q, ent e),
hlex AS (SELECT query_id, entity_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, m DESC, entity_id) AS rn FROM hl WHERE score > 0) WHERE rn <= 12),
hvec AS (SELECT query_id, ref_id AS entity_id, score FROM vh WHERE kind = 'entity' AND rn <= 12),
hraw AS (SELECT * FROM {_best("entity_id", "hlex", "hvec")} WHERE score > 0),
hadj AS (SELECT s.query_id, s.entity_id, s.score * {_SPEC.format("d")} AS score FROM hraw s LEFT JOIN df d USING (entity_id)),
hp AS MATERIALIZED (SELECT query_id, entity_id, score / sum(score) OVER (PARTITION BY query_id) AS p FROM hadj WHERE score > 0),
n0 AS (SELECT query_id, entity_id FROM hp)"""
    for i in (1, 2):
        out += f", n{i} AS MATERIALIZED (SELECT query_id, entity_id FROM n{i - 1} UNION SELECT h.query_id, b.neighbour_id FROM n{i - 1} h JOIN both_ways b USING (entity_id))"
    out += """,
hedge AS MATERIALIZED (SELECT a.query_id, r.subject_entity_id AS source, r.object_entity_id AS target, r.confidence AS weight FROM rel r JOIN n2 a ON a.entity_id = r.subject_entity_id JOIN n2 b ON b.entity_id = r.object_entity_id AND b.query_id = a.query_id WHERE r.confidence > 0),
hpair AS (SELECT * FROM hedge UNION ALL SELECT query_id, target, source, weight FROM hedge),
hsum AS (SELECT query_id, source, target, sum(weight) AS weight FROM hpair GROUP BY query_id, source, target),
hstep AS MATERIALIZED (SELECT query_id, source, target, weight / sum(weight) OVER (PARTITION BY query_id, source) AS part FROM hsum),
hsrc AS MATERIALIZED (SELECT DISTINCT query_id, source FROM hstep),
w0 AS (SELECT query_id, entity_id, p AS score FROM hp)"""
    for i in range(1, _ITERATIONS + 1):
        out += f""",
w{i} AS MATERIALIZED (
  SELECT query_id, entity_id, sum(score) AS score FROM (
    SELECT s.query_id, s.target AS entity_id, 0.85 * s.part * w.score AS score FROM hstep s JOIN w{i - 1} w ON w.query_id = s.query_id AND w.entity_id = s.source
    UNION ALL SELECT p.query_id, p.entity_id, p.p * (0.15 + 0.85 * coalesce(k.sunk, 0)) FROM hp p
      LEFT JOIN (SELECT w.query_id, sum(w.score) AS sunk FROM w{i - 1} w LEFT JOIN hsrc s ON s.query_id = w.query_id AND s.source = w.entity_id WHERE s.source IS NULL GROUP BY w.query_id) k USING (query_id)
  ) GROUP BY query_id, entity_id
)"""
    return out + f""",
hrank AS MATERIALIZED (SELECT * FROM w{_ITERATIONS} WHERE score > 0),
htop AS MATERIALIZED (SELECT * FROM {_top("hrank", "entity_id", 40)}),
hnear AS MATERIALIZED (SELECT * FROM {_touch("htop")}),
hkept AS (SELECT * FROM {_top("hnear", "relation_id", 80)}),
hrel AS MATERIALIZED (
  SELECT k.query_id, k.relation_id, greatest(coalesce(a.score, 0), coalesce(b.score, 0)) * r.confidence AS score
  FROM hkept k JOIN rel r USING (relation_id) LEFT JOIN hrank a ON a.query_id = k.query_id AND a.entity_id = r.subject_entity_id LEFT JOIN hrank b ON b.query_id = k.query_id AND b.entity_id = r.object_entity_id
),
hparts AS (
  SELECT t.query_id, m.chunk_id, t.score * m.confidence AS score FROM men m JOIN htop t USING (entity_id)
  UNION ALL SELECT x.query_id, ev.chunk_id, x.score FROM ev JOIN hrel x USING (relation_id) WHERE x.score > 0
),
hall AS MATERIALIZED (SELECT query_id, chunk_id, sum(score) AS score FROM hparts GROUP BY query_id, chunk_id),
hwide AS (SELECT * FROM {_top("hall", "chunk_id", 36)} WHERE chunk_id IN (SELECT chunk_id FROM ch)),
o_hent AS MATERIALIZED (SELECT * FROM htop WHERE entity_id IN (SELECT entity_id FROM ent)), o_hch AS MATERIALIZED (SELECT * FROM {_top("hwide", "chunk_id", 12)})
"""


_VECTOR = "vch AS MATERIALIZED (SELECT query_id, ref_id AS chunk_id, score FROM vh WHERE kind = 'chunk' AND rn <= 10)"
_FUSED = f""", {_VECTOR},
br AS (SELECT *, 'vector' AS branch FROM vch UNION ALL SELECT query_id, chunk_id, round(score, 9), 'light' FROM o_ch UNION ALL SELECT query_id, chunk_id, round(score, 9), 'hippo' FROM o_hch),
bn AS (SELECT *, row_number() OVER (PARTITION BY query_id, branch ORDER BY score DESC, chunk_id) AS rn FROM br),
fu AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rn)) AS score, string_agg(DISTINCT branch, ',' ORDER BY branch) AS branches, max(score) AS best_score FROM bn GROUP BY query_id, chunk_id),
mixed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM fu QUALIFY rank <= 12)
"""
_TERMS = ", ".join(f"({_quoted(q[0])}, [{', '.join(map(_quoted, q[4]))}])" for q in QUESTIONS)
_LOWERED = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


def _entity_line() -> str:
    return "'- ' || coalesce(e.name, '') || ' (' || coalesce(e.entity_type, '') || ')' || CASE WHEN coalesce(e.description, '') <> '' THEN ': ' || e.description ELSE '' END"


def _relation_line() -> str:
    said = lambda label, c: f"CASE WHEN coalesce({c}, '') <> '' THEN '{label}' || {c} END"
    head = "'- ' || coalesce(v.subject_name, '') || ' -[' || coalesce(v.relation_type, '') || ']-> ' || coalesce(v.object_name, '')"
    return f"concat_ws(chr(10), {head}, {said('  Mô tả: ', 'v.description')}, {said('  Keywords: ', chr(39).join(('array_to_string(list_sort(v.keywords), ', ', ', ')')))}, {said('  Evidence: ', 'v.evidence_text')})"


def _chunk_line() -> str:
    more = "".join(f" || CASE WHEN coalesce(c.{x}, '') <> '' THEN ' | ' || c.{x} ELSE '' END" for x in ("section", "subsection"))
    return f"'[Chunk ' || c.chunk_id || '] ' || coalesce(nullif(c.title, ''), 'Unknown title'){more} || chr(10) || coalesce(nullif(c.contextualized_text, ''), c.text, '')"


def _numbered(cte: str, key: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {key}) AS rank FROM {cte})"


_LINES = (_LIGHT + _walk() + _FUSED + """, k AS (
  SELECT m.query_id, m.rank, concat_ws(' | ', '[Context ' || m.rank || ']', 'chunk_id=' || c.chunk_id, CASE WHEN c.title <> '' THEN 'title=' || c.title END, CASE WHEN c.section <> '' THEN 'section=' || c.section END) || chr(10) || trim(coalesce(nullif(c.text, ''), c.contextualized_text, '')) AS line
  FROM mixed m JOIN ch c USING (chunk_id) WHERE m.rank <= 8 AND trim(coalesce(nullif(c.text, ''), c.contextualized_text, '')) <> ''
), t AS (SELECT query_id, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS lines FROM k GROUP BY query_id)""")
_TEXTS = ", ".join(f"({_quoted(i)}, {_quoted(q)})" for i, q in ASKED)

SQL = {
    "compact_results": _LIGHT + f""", e1 AS (SELECT o.query_id, string_agg(coalesce(e.name, ''), '|' ORDER BY o.rank) AS entities FROM {_numbered("o_ent", "entity_id")} o JOIN ent e USING (entity_id) WHERE o.rank <= 10 GROUP BY o.query_id),
r1 AS (SELECT o.query_id, string_agg(coalesce(v.subject_name, '') || ' -[' || v.relation_type || ']-> ' || coalesce(v.object_name, ''), '|' ORDER BY o.rank) AS relations FROM {_numbered("o_rel", "relation_id")} o JOIN v USING (relation_id) WHERE o.rank <= 10 GROUP BY o.query_id),
c1 AS (SELECT query_id, string_agg(chunk_id, '|' ORDER BY rank) AS chunks FROM {_numbered("o_ch", "chunk_id")} WHERE rank <= 10 GROUP BY query_id)
SELECT a.query_id, e1.entities, r1.relations, c1.chunks FROM asked a LEFT JOIN e1 USING (query_id) LEFT JOIN r1 USING (query_id) LEFT JOIN c1 USING (query_id)""",
    "payload_hits": _HITS + """, ti AS (SELECT payload.ref_id AS ref_id, min(nullif(trim(payload.title), '')) AS title FROM vector_points GROUP BY 1),
ow AS (SELECT entity_id AS ref_id, name FROM ent UNION ALL SELECT chunk_id, title FROM ch)
SELECT h.query_id, CASE h.kind WHEN 'entity' THEN 'lightrag_entity' ELSE 'vector_chunk' END AS source, h.ref_id, coalesce(ti.title, nullif(ow.name, ''), h.ref_id) AS title, round(h.score, 7) AS score
FROM vh h LEFT JOIN ti USING (ref_id) LEFT JOIN ow USING (ref_id) WHERE h.rn <= 5""",
    "query_keywords": "SELECT * FROM (VALUES "
    + ", ".join(
        f"({_quoted(i)}, {_quoted('|'.join(r['low']))}, {_quoted('|'.join(r['high']))}, {_quoted(r['low_text'])}, {_quoted(r['high_text'])}, {_quoted(r['intent'])}, {_quoted('|'.join(r['types'])) if r['types'] else 'NULL'}, {_quoted('|'.join(dict.fromkeys([*r['high'], *r['low']])))})"
        for i, r in _READ.items()
    )
    + ") t(query_id, low, high, low_text, high_text, intent, types, united)",
    "vector_rag": _HITS + "SELECT query_id, ref_id AS chunk_id, round(score, 7) AS score FROM vh WHERE kind = 'chunk' AND rn <= 10",
    "entity_expansion": _HITS + _around("x", "eh") + _show(entities=("x_ent", "entity_id"), relations=("x_rel", "relation_id"), chunks=("x_ch", "chunk_id")),
    "relation_expansion": _HITS + _from_relations("x", "rh") + _show(entities=("x_ent", "entity_id"), relations=("x_rel", "relation_id"), chunks=("x_ch", "chunk_id")),
    "lightrag": _LIGHT + _show(entities=("o_ent", "entity_id"), relations=("o_rel", "relation_id"), chunks=("o_ch", "chunk_id"), candidates=("lcand", "entity_id")),
    "hipporag": _HITS + _walk() + _show(entities=("o_hent", "entity_id"), relations=("hrel", "relation_id"), chunks=("o_hch", "chunk_id")),
    "hippo_support": _HITS + _walk() + """, e AS (SELECT o.query_id, o.chunk_id, string_agg(DISTINCT t.entity_id, ',' ORDER BY t.entity_id) AS ids FROM o_hch o JOIN men m USING (chunk_id) JOIN o_hent t ON t.query_id = o.query_id AND t.entity_id = m.entity_id GROUP BY ALL),
q AS (SELECT o.query_id, o.chunk_id, string_agg(DISTINCT x.relation_id, ',' ORDER BY x.relation_id) AS ids FROM o_hch o JOIN ev USING (chunk_id) JOIN hrel x ON x.query_id = o.query_id AND x.relation_id = ev.relation_id WHERE x.score > 0 GROUP BY ALL)
SELECT o.query_id, o.chunk_id, coalesce(e.ids, '') AS entity_ids, coalesce(q.ids, '') AS relation_ids FROM o_hch o LEFT JOIN e USING (query_id, chunk_id) LEFT JOIN q USING (query_id, chunk_id)""",
    "mixed_rag": _LIGHT + _walk() + _FUSED + "SELECT query_id, chunk_id, round(score, 9) AS score, branches, round(best_score, 6) AS best_score FROM mixed",
    "lightrag_context": _LIGHT + f""", e1 AS (SELECT o.query_id, string_agg({_entity_line()}, chr(10) ORDER BY o.rank) AS lines FROM {_numbered("o_ent", "entity_id")} o JOIN ent e USING (entity_id) GROUP BY o.query_id),
r1 AS (SELECT o.query_id, string_agg({_relation_line()}, chr(10) ORDER BY o.rank) AS lines FROM {_numbered("o_rel", "relation_id")} o JOIN v USING (relation_id) GROUP BY o.query_id),
c1 AS (SELECT o.query_id, string_agg({_chunk_line()}, chr(10) || chr(10) ORDER BY o.rank) AS lines FROM {_numbered("o_ch", "chunk_id")} o JOIN ch c USING (chunk_id) GROUP BY o.query_id),
t AS (SELECT a.query_id, concat_ws(chr(10) || chr(10), '## Query keywords' || chr(10) || 'Low-level: ' || a.low_words || chr(10) || 'High-level: ' || a.high_words, '## Entities' || chr(10) || e1.lines, '## Relations' || chr(10) || r1.lines, '## Source chunks' || chr(10) || c1.lines) AS context
  FROM asked a LEFT JOIN e1 USING (query_id) LEFT JOIN r1 USING (query_id) LEFT JOIN c1 USING (query_id))
SELECT query_id, length(context) AS n_chars, md5(context) AS context FROM t""",
    "mixed_evidence": _LINES + "SELECT query_id, length(lines) AS n_chars, md5(lines) AS lines FROM t",
    "answers": _LINES + f", q(query_id, text) AS (VALUES {_TEXTS}) SELECT q.query_id, true AS ok, md5('Context:' || chr(10) || coalesce(t.lines, '') || chr(10) || chr(10) || 'Question: ' || q.text) AS answer, 1 AS attempt FROM q LEFT JOIN t USING (query_id)",
    "retrieval_evaluation": _LIGHT + _walk() + f""", {_VECTOR},
terms(query_id, terms) AS (VALUES {_TERMS}),
hits AS (SELECT 'vector' AS method, * FROM vch UNION ALL SELECT 'lightrag', * FROM o_ch UNION ALL SELECT 'hipporag', * FROM o_hch),
ranked AS (SELECT method, query_id, chunk_id, row_number() OVER (PARTITION BY method, query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM hits QUALIFY rank <= 10),
seen AS (
  SELECT r.method, r.query_id, r.rank, list_filter(t.terms, lambda z: contains({_LOWERED.format("concat_ws(chr(10), coalesce(c.title, ''), coalesce(c.section, ''), coalesce(c.text, ''), coalesce(c.contextualized_text, ''))")}, {_LOWERED.format("z")})) AS met
  FROM ranked r JOIN ch c USING (chunk_id) JOIN terms t USING (query_id)
),
per AS (SELECT method, query_id, min(CASE WHEN len(met) > 0 THEN rank END) AS first_hit_rank, flatten(list(met)) AS met FROM seen GROUP BY method, query_id)
SELECT x.method, t.query_id, p.first_hit_rank, CAST(coalesce(p.first_hit_rank <= 1, false) AS INTEGER) AS hit_at_1, CAST(coalesce(p.first_hit_rank <= 3, false) AS INTEGER) AS hit_at_3, CAST(coalesce(p.first_hit_rank <= 5, false) AS INTEGER) AS hit_at_5,
  coalesce(round(1.0 / p.first_hit_rank, 4), 0) AS mrr, array_to_string(list_filter(t.terms, lambda z: list_contains(coalesce(p.met, []), z)), '|') AS matched_terms
FROM terms t CROSS JOIN (VALUES ('vector'), ('lightrag'), ('hipporag')) x(method) LEFT JOIN per p ON p.query_id = t.query_id AND p.method = x.method""",
}
