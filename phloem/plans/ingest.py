"""Ingest as one plan over all articles: chunks, extracted records, resolved entities, relations, mentions, vectors and counts.

A record is what a model extracted from a chunk, or a table that replays it: (chunk_id, ok, entities, relations). Entities
are resolved by an id of type and folded name, so that resolving needs no look-up in the graph and no order of writes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phloem.functions import text as t
from phloem.operators import docs, extract, merge
from phloem.plans import models, profiles
from phloem.storage import Stage

ENTITY = "struct<name:string,entity_type:string,description:string,evidence_text:string>"
RELATION = "struct<subject:string,subject_type:string,relation_type:string,object:string,object_type:string,description:string,keywords:array<string>,evidence_text:string,confidence:double>"


@dataclass
class Written:
    """What an ingest writes."""

    entities: DataFrame
    relations: DataFrame
    mentions: DataFrame
    chunk_stats: DataFrame


def chunked(articles: DataFrame, budget: int = 900) -> DataFrame:
    """Chunks of cleaned articles (article_id, title, body)."""
    cleaned = articles.withColumn("body", docs.clean_body(F.col("body"), F.coalesce("title", F.lit(""))))
    return docs.chunks(docs.sections(cleaned), cleaned, budget)


def entity_rows(records: DataFrame) -> DataFrame:
    """A row an extracted entity of the records that went well."""
    return records.filter("ok").select("chunk_id", F.posexplode("entities").alias("seq", "e")).select("chunk_id", "seq", "e.*")


def relation_rows(records: DataFrame) -> DataFrame:
    return records.filter("ok").select("chunk_id", F.posexplode("relations").alias("seq", "r")).select("chunk_id", "seq", "r.*")


def with_forgotten_ends(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entity rows of valid extractions, with the ends of relations that their own chunk names no entity for."""
    columns = ("chunk_id", "name", "entity_type", "description", "evidence_text", "seq")
    ends = relations.select(
        "chunk_id", F.explode(F.array(F.struct(F.col("subject").alias("name"), F.col("subject_type").alias("entity_type")), F.struct(F.col("object").alias("name"), F.col("object_type").alias("entity_type")))).alias("e"), "evidence_text", "seq"
    ).select("chunk_id", "e.name", "e.entity_type", F.lit("").alias("description"), "evidence_text", (F.col("seq") + 1_000_000).alias("seq"))
    key = ["chunk_id", "__key", "entity_type"]
    keyed = lambda d: d.withColumn("__key", t.folded("name"))
    missing = keyed(ends).join(keyed(entities).select(*key).distinct(), key, "left_anti")
    once = missing.groupBy(*key).agg(F.min(F.struct("seq", "name", "description", "evidence_text")).alias("x")).select("chunk_id", "x.name", "entity_type", "x.description", "x.evidence_text", "x.seq")
    return entities.select(*columns).unionByName(once.select(*columns))


def write_graph(records: DataFrame, chunks: DataFrame) -> Written:
    """Entities, relations and mentions after all records, and counts by chunk.

    Per chunk and folded name and type one entity counts, the first; relations are validated and the first of each
    five-part key in a chunk counts; keywords are those of the relation's profile; forgotten ends become entities.
    Entities take the first non-empty texts by chunk and place, mentions add up by chunk, relations keep the largest
    confidence and unite evidence. chunks: chunk_id, section, source_url. Records of chunks that do not exist are left out.
    Valid relations and entities, which several results read, are written once.
    """
    stage = Stage(records.sparkSession, "ingest")
    known = records.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    raw_relations = relation_rows(known)
    named = raw_relations.withColumns({c: t.shown(c) for c in ("subject", "object")})
    valid = extract.valid_relations(named.withColumn("__place", F.struct("chunk_id", "seq")), "__place", "chunk_id").drop("__place", "keywords")
    valid = valid.withColumns({f"{end}_entity_id": t.name_id(f"{end}_key", f"{end}_type") for end in ("subject", "object")})
    valid = stage.write(valid.withColumn("relation_id", t.relation_id("subject_entity_id", "relation_type", "object_entity_id")), "relations")
    rows = entity_rows(known).withColumn("name", t.shown("name"))
    good = rows.filter(F.col("entity_type").isin(list(extract.schema.ENTITY_TYPES)) & ~extract.bad_name(F.col("name")))
    everyone = with_forgotten_ends(good, valid).withColumn("entity_id", t.name_id(t.folded("name"), "entity_type"))
    per_chunk = everyone.groupBy("chunk_id", "entity_id").agg(F.min(F.struct("seq", "name", "entity_type", "description", "evidence_text")).alias("x")).select("chunk_id", "entity_id", "x.*")
    order = ("chunk_id", "seq")
    entities = per_chunk.groupBy("entity_id").agg(
        merge.first_text("name", *order).alias("name"), F.min("entity_type").alias("entity_type"), merge.first_text("description", *order).alias("description"), F.count("*").alias("mention_count"),
        F.array_sort(F.collect_set("name")).alias("surface_forms"),
    ).withColumns({"normalized_name": t.fold_name("name"), "aliases": F.array().cast("array<string>")})
    entities = stage.write(entities, "entities")
    mentions = per_chunk.join(chunks.select("chunk_id", "section"), "chunk_id").select("chunk_id", "entity_id", F.lit(1.0).alias("confidence"), "evidence_text", "section")
    words = profiles.relation_keywords()
    worded = valid.withColumns({"subject_name": F.col("subject"), "object_name": F.col("object")}).withColumn("keywords", words).join(chunks.select("chunk_id", "section", "source_url"), "chunk_id")
    place = ("chunk_id", "seq")
    relations = worded.groupBy("relation_id").agg(
        F.min("subject_entity_id").alias("subject_entity_id"), F.min("object_entity_id").alias("object_entity_id"), F.min("relation_type").alias("relation_type"),
        merge.first_text("description", *place).alias("description"), merge.first_text("evidence_text", *place).alias("evidence_text"), merge.first_text("section", *place).alias("section"), merge.first_text("source_url", *place).alias("source_url"),
        F.coalesce(F.max(F.when(F.col("confidence").between(0, 1), F.col("confidence"))), F.lit(1.0)).alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("keywords")))).alias("keywords"), F.array_sort(F.collect_set("chunk_id")).alias("evidence_chunk_ids"),
    )
    stats = known.select(
        "chunk_id", F.col("ok"), F.when(F.col("ok"), F.size(F.coalesce("entities", F.array().cast(f"array<{ENTITY}>")))).otherwise(0).alias("raw_entities"), F.when(F.col("ok"), F.size(F.coalesce("relations", F.array().cast(f"array<{RELATION}>")))).otherwise(0).alias("raw_relations"),
        F.when(F.col("ok"), F.size(F.filter("relations", lambda r: r["relation_type"] == "DONG_NGHIA_VOI"))).otherwise(0).alias("synonym_relations"),
        F.when(F.col("ok"), F.size(F.filter("relations", lambda r: F.coalesce(F.size(r["keywords"]), F.lit(0)) <= 0))).otherwise(0).alias("without_keywords"),
    )
    stats = stats.join(per_chunk.groupBy("chunk_id").agg(F.count("*").alias("entity_writes")), "chunk_id", "left").join(worded.groupBy("chunk_id").agg(F.count("*").alias("relation_writes")), "chunk_id", "left")
    return Written(entities, relations, mentions, stats.fillna(0, ["entity_writes", "relation_writes"]))


def points(kind: str, rows: DataFrame, key: str, text: str, model: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None) -> DataFrame:
    """Vector points of records: point_id, kind, ref_id, text, and the vector if a model is given. Records without text have none."""
    named = rows.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(t.point_id(kind, key).alias("point_id"), F.lit(kind).alias("kind"), F.col(key).alias("ref_id"), F.col(text).alias("text"))
    return models.embed(named, "text", model) if model else named


def vector_points(written: Written, chunks: DataFrame, model: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None) -> DataFrame:
    """Points of chunks, entities and relations by the texts that ``profiles`` builds of them."""
    names = written.entities.select("entity_id", "name")
    end = lambda p: names.select(F.col("entity_id").alias(f"{p}_entity_id"), F.col("name").alias(f"{p}_name"))
    relations = written.relations.join(end("subject"), "subject_entity_id").join(end("object"), "object_entity_id").withColumn("__text", profiles.relation_text())
    entities = profiles.entity_profiles(written.entities).withColumn("__text", profiles.entity_text()).select("entity_id", "__text")
    entities = Stage(chunks.sparkSession, "points").write(entities, "entities")  # a filter by text would compute the profiles again
    out = points("chunk", chunks.withColumn("__text", profiles.chunk_text()), "chunk_id", "__text", model)
    return out.unionByName(points("entity", entities, "entity_id", "__text", model)).unionByName(points("relation", relations, "relation_id", "__text", model))


def article_stats(chunk_stats: DataFrame, chunks: DataFrame) -> DataFrame:
    """(article_id, chunks, failed_chunks, ... sums): the counts of a run by article; chunks without a record count as failed."""
    names = ("raw_entities", "raw_relations", "synonym_relations", "without_keywords", "entity_writes", "relation_writes")
    both = chunks.select("article_id", "chunk_id").join(chunk_stats, "chunk_id", "left")
    return both.groupBy("article_id").agg(F.count("*").alias("chunks"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed_chunks"), *[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in names])
