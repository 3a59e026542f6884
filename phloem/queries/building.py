"""Profiles, validated keywords, judged answers, ingest and page clean-up over the project's tables; the SQL is in building_sql."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phloem.functions import text as t
from phloem.operators import docs, extract, graph
from phloem.plans import ingest, judge, profiles
from phloem.queries.graph import Graph
from phloem.queries.building_sql import CUES, SQL  # noqa: F401
from phloem.storage import Stage, table

_NONE = "array<string>"


def _evidence(x: Graph) -> DataFrame:
    """(entity_id, evidence): up to five texts of chunks that mention an entity, in order; five is the profile's own limit."""
    texts = x.mentions.join(x.chunks.select("chunk_id", "text"), "chunk_id").filter("text <> ''").select("entity_id", "text").distinct()
    ranked = texts.withColumn("n", F.row_number().over(graph.Window.partitionBy("entity_id").orderBy("text"))).filter("n <= 5")
    return ranked.groupBy("entity_id").agg(F.array_sort(F.collect_list("text")).alias("evidence"))


def _entity_profiles(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    made = profiles.entity_profiles(x.entities.drop("profile_text").join(_evidence(x), "entity_id", "left"), "evidence")
    return made.select("entity_id", F.array_join("local_keys", "|").alias("local_keys"), F.array_join("global_keys", "|").alias("global_keys"), F.md5("profile_text").alias("profile"))


def _relation_profiles(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    named = graph.with_names(x.relations, x.entities)
    return named.select("relation_id", F.array_join(profiles.relation_keywords(), "|").alias("keywords"))


def _regenerated(spark: SparkSession, d: str) -> DataFrame:
    """Relations whose keywords the profile changes, with the text that is embedded anew."""
    x = Graph(spark, d)
    named = graph.with_names(x.relations, x.entities).withColumn("keywords", profiles.relation_keywords())
    old = x.raw["relations"].select("relation_id", F.explode("keywords").alias("k")).filter("trim(k) <> ''").groupBy("relation_id").agg(F.array_sort(F.collect_set("k")).alias("old"))
    both = named.join(old, "relation_id", "left").filter(~F.coalesce(F.array_sort("keywords") == F.col("old"), F.lit(False)))
    return both.select("relation_id", F.md5(profiles.relation_text()).alias("embedded"))


def _validated_keywords(spark: SparkSession, d: str) -> DataFrame:
    x = Graph(spark, d)
    rows = table(spark, d, "relations").filter("relation_id is not null").select("relation_id", "subject_entity_id", "object_entity_id", "relation_type", "keywords").distinct()
    named = graph.with_names(rows, x.entities).withColumn("kind", graph.relation_kind())
    clean = profiles.validated_keywords(F.concat(F.coalesce("keywords", F.array().cast(_NONE)), F.array(F.lit("bác sĩ"), F.lit(" **ho  khan** "))), 3)
    fallback = profiles.fallback_keywords(F.col("subject_name"), F.col("kind"), F.col("object_name"))
    return named.select("relation_id", F.array_join(clean, "|").alias("clean"), F.array_join(fallback, "|").alias("fallback")).distinct()


def _judge_rows(spark: SparkSession, d: str) -> DataFrame:
    """Judged answers replayed: a chunk's text as the answer, its text in context as evidence, vectors of the embeddings table."""
    chunks = graph.current_chunks(table(spark, d, "chunks")).filter("text is not null").select("chunk_id", "chunk_index", "text", F.coalesce("contextualized_text", F.lit("")).alias("context"), F.coalesce("title", F.lit("")).alias("title"), "token_count")
    vectors = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = F.pmod(F.conv(F.substring(F.md5("chunk_id"), 1, 6), 16, 10).cast("long"), F.lit(40))
    rows = chunks.withColumn("statements", judge.statements_of(F.col("text"))).withColumn("q", n).withColumn("g", n + 1)
    rows = rows.join(vectors.select(F.col("vec_id").alias("q"), F.col("v").alias("question_vector")), "q").join(vectors.select(F.col("vec_id").alias("g"), F.array("v").alias("generated_vectors")), "g")
    return rows.withColumns(
        {
            "support": F.transform("statements", lambda x: F.length(x) % 3 != 0),
            "relevant": F.filter(judge.context_sentences(F.col("context")), lambda x: F.length(x) % 2 == 0),
            "safety": F.pmod(F.coalesce("token_count", F.lit(0)), F.lit(11)).cast("string"),
            "correctness": F.pmod(F.coalesce("token_count", F.lit(0)), F.lit(6)).cast("string"),
            "reference": F.col("title"),
        }
    )


def _judged(spark: SparkSession, d: str) -> DataFrame:
    out = judge.judged(_judge_rows(spark, d))
    return out.select("chunk_id", "n_sentences", *[F.round(c, 6).alias(c) for c in ("faithfulness", "answer_relevance", "context_relevance", "safety", "answer_correctness", "overall")], "verdict")


def _judge_summary(spark: SparkSession, d: str) -> DataFrame:
    out = judge.judged(_judge_rows(spark, d))
    return out.groupBy("verdict").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("faithfulness", "answer_relevance", "context_relevance", "safety", "answer_correctness")])


def _snippets(spark: SparkSession, d: str) -> DataFrame:
    """What stands around the cues of synonymy in each chunk."""
    rows = graph.current_chunks(table(spark, d, "chunks")).filter("text is not null").withColumn("s", judge.snippets(F.col("text"), CUES, 40, 3)).filter(F.size("s") > 0)
    return rows.select("chunk_id", F.size("s").alias("n"), F.array_join("s", "|").alias("snippets"))


def _cue_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = graph.current_chunks(table(spark, d, "chunks")).select("chunk_id", t.fold(F.coalesce("text", F.lit(""))).alias("said"))
    return rows.select("chunk_id", t.contains_any(F.col("said"), extract.SYNONYM_FOR).alias("says_synonym"), t.contains_any(F.col("said"), ("nguyen nhan", "bien chung")).alias("watched"))


def replay(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(records, chunks): extraction records replayed from the relations table, each for its evidence chunks, and the chunks."""
    x = Graph(spark, d)
    named = graph.with_names(x.raw["relations"].select("relation_id", "subject_entity_id", "object_entity_id", graph.relation_kind().alias("relation_type"), "description", "keywords", "evidence_text", "confidence").distinct(), x.entities)
    chunk_ids = x.chunks.select("chunk_id", "article_id", "section", "source_url", "text", "contextualized_text")
    met = named.join(x.links, "relation_id").join(chunk_ids.select("chunk_id"), "chunk_id", "left_semi")
    relation = F.struct(
        F.coalesce("subject_name", F.lit("")).alias("subject"), F.col("subject_type"), "relation_type", F.coalesce("object_name", F.lit("")).alias("object"), F.col("object_type"), "description", "keywords", "evidence_text", "confidence"
    )
    entity = F.struct(F.col("subject_name").alias("name"), F.col("subject_type").alias("entity_type"), F.col("description"), F.col("evidence_text"))
    gathered = met.groupBy("chunk_id").agg(F.array_sort(F.collect_list(relation)).alias("relations"), F.array_sort(F.collect_set(entity)).alias("entities"))  # what one chunk's model call gives
    records = gathered.select("chunk_id", (F.pmod(F.conv(F.substring(F.md5("chunk_id"), 1, 6), 16, 10).cast("long"), F.lit(50)) != 0).alias("ok"), "entities", "relations")
    stage = Stage(spark, "replay")
    return stage.write(records, "records"), stage.write(chunk_ids, "chunks")


def _written(spark: SparkSession, d: str) -> tuple[ingest.Written, DataFrame]:
    records, chunks = replay(spark, d)
    return ingest.write_graph(records, chunks), chunks


def _ingest_entities(spark: SparkSession, d: str) -> DataFrame:
    w, _ = _written(spark, d)
    return w.entities.select("entity_id", "name", "normalized_name", "entity_type", "mention_count", F.array_join("surface_forms", "|").alias("surface_forms"))


def _ingest_relations(spark: SparkSession, d: str) -> DataFrame:
    w, _ = _written(spark, d)
    return w.relations.select("relation_id", "subject_entity_id", "object_entity_id", "relation_type", "confidence", F.array_join("evidence_chunk_ids", "|").alias("chunks"), F.array_join("keywords", "|").alias("keywords"))


def _ingest_mentions(spark: SparkSession, d: str) -> DataFrame:
    w, _ = _written(spark, d)
    return w.mentions.select("chunk_id", "entity_id", "confidence")


def _ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    w, chunks = _written(spark, d)
    return ingest.article_stats(w.chunk_stats, chunks)


def _ingest_points(spark: SparkSession, d: str) -> DataFrame:
    w, chunks = _written(spark, d)
    return ingest.vector_points(w, chunks).select("point_id", "kind", "ref_id", F.md5("text").alias("text"))


def _naive_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Points of the raw text of every live chunk that has any."""
    return ingest.points("naive", graph.current_chunks(table(spark, d, "chunks")), "chunk_id", "text").select("point_id", "ref_id", F.md5("text").alias("text"))


def _article_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Articles with the counts of their chunks after both are upserted and linked."""
    x = Graph(spark, d)
    linked = x.chunks.join(x.articles.select("article_id"), "article_id", "left_semi")
    per = linked.groupBy("article_id").agg(F.count("*").alias("n_chunks"), F.max("chunk_index").alias("last_index"))
    return x.articles.select("article_id", "title").join(per, "article_id", "left").fillna(0, ["n_chunks"])


def _promoted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "article_items").filter("markdown is not null").select("item_id", "markdown").distinct()
    return rows.select("item_id", F.md5(docs.promote_headings(F.col("markdown"))).alias("promoted"))


def _cut(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "article_items").filter("markdown is not null").select("item_id", "markdown").distinct()
    return rows.select("item_id", F.length(docs.cut_at(F.col("markdown"))).alias("n_chars"))


def _intro(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "article_items").filter("markdown is not null").select("item_id", "title", "markdown").distinct()
    return rows.select("item_id", F.md5(docs.without_intro(F.col("markdown"), F.coalesce("title", F.lit("")))).alias("text"))


def _page_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """All steps of the page clean-up: intro, headings, cut, noise lines."""
    rows = table(spark, d, "article_items").filter("markdown is not null").select("item_id", "title", "markdown").distinct()
    return docs.clean_pages(rows).select("item_id", F.md5("markdown").alias("text"))


QUERIES = {
    "entity_profiles": _entity_profiles, "relation_profiles": _relation_profiles, "regenerated_relations": _regenerated, "validated_keywords": _validated_keywords, "judged_answers": _judged, "judge_summary": _judge_summary,
    "cue_snippets": _snippets, "cue_flags": _cue_flags, "ingest_entities": _ingest_entities, "ingest_relations": _ingest_relations, "ingest_mentions": _ingest_mentions, "ingest_stats": _ingest_stats, "ingest_points": _ingest_points,
    "naive_backfill": _naive_backfill, "article_chunks": _article_chunks, "promoted_headings": _promoted, "cut_pages": _cut, "intro_lines": _intro, "page_cleanup": _page_cleanup,
}
