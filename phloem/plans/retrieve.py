"""Composed retrieval for a batch of questions: vector search, graph expansion, two-level and associative retrieval, fusion.

Everything is keyed by query_id, so a batch is one plan. Results have the columns query_id, the record's id and score;
ties go to the smaller id. Intermediate hits that several branches read are written once, they are at most a few
hundred rows a question.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phloem.functions import text as t
from phloem.operators import graph as g
from phloem.operators import rank as r
from phloem.operators import vector
from phloem.storage import Stage


@dataclass(frozen=True)
class Limits:
    """How much each step keeps for a question."""

    vector_top_k: int = 10
    entity_top_k: int = 20
    relation_top_k: int = 20
    synonyms: int = 30
    graph_relations: int = 80
    graph_chunks: int = 50
    diseases: int = 8
    seeds: int = 12
    ranked_entities: int = 40
    max_entities: int = 30
    max_relations: int = 40
    max_chunks: int = 12
    mixed_entities: int = 40
    mixed_relations: int = 60
    hops: int = 2
    iterations: int = 100
    tolerance: float = 1e-7


@dataclass
class Tables:
    """The graph that retrieval reads: current entities and chunks, merged relations, evidence links and mentions."""

    entities: DataFrame
    relations: DataFrame
    links: DataFrame
    mentions: DataFrame
    chunks: DataFrame


def best(hits: list[DataFrame], key: str) -> DataFrame:
    """Hits of several branches, the best score of each record."""
    each = [h.select("query_id", key, F.col("score").cast("double").alias("score")) for h in hits]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.groupBy("query_id", key).agg(F.max("score").alias("score"))


def first(hits: DataFrame, key: str, n: int) -> DataFrame:
    """A query's n best hits; scores that agree to nine digits are equal, as sums differ by the order in which they are made."""
    return g.top_per_query(hits, n, F.round("score", 9).desc(), F.asc(key)).select("query_id", key, "score")


def vector_hits(vectors: DataFrame, points: DataFrame, kind: str, existing: DataFrame, key: str, k: int) -> DataFrame:
    """(query_id, key, score): the k points of one kind that are closest to each question's vector and whose record exists.

    points: (kind, ref_id, vector); vectors: (query_id, vector).
    """
    own = points.filter(F.col("kind") == kind).join(existing.select(F.col(key).alias("ref_id")), "ref_id", "left_semi")
    found = vector.topk(vectors, own, k, "cosine", point_id="ref_id")
    return found.select("query_id", F.col("ref_id").alias(key), "score")


def of_types(relations: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """A query's relations of the types that it asks for; a query without types (null) keeps all."""
    if wanted is None:
        return relations
    joined = relations.join(wanted.select("query_id", "types"), "query_id")
    return joined.filter(F.col("types").isNull() | F.array_contains("types", F.col("relation_type"))).drop("types")


def with_synonyms(x: Tables, seeds: DataFrame, n: int) -> DataFrame:
    """(query_id, entity_id): the seeds and their best synonyms of the same type."""
    found = g.top_per_query(g.synonym_neighbours(x.relations, x.entities, seeds), n, F.desc("score"), F.desc("mention_count"), F.asc("entity_id"))
    return seeds.select("query_id", "entity_id").union(found.select("query_id", "entity_id")).distinct()


def entity_bundle(x: Tables, ids: DataFrame, wanted: DataFrame | None, relations: int, chunks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, chunks) around a set of entities: their relations by confidence, and the chunks that are evidence of those."""
    entities = ids.join(x.entities.select("entity_id"), "entity_id", "left_semi").select("query_id", "entity_id", F.lit(1.0).alias("score"))
    touching = of_types(g.relations_touching(x.relations, ids), wanted).withColumn("score", F.col("confidence"))
    kept = first(touching, "relation_id", relations)
    return entities, kept, first(g.evidence_chunks(x.links, kept, x.chunks), "chunk_id", chunks)


def expand_entities(x: Tables, seeds: DataFrame, wanted: DataFrame | None = None, limits: Limits = Limits(), synonyms: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Local expansion: seeds, their synonyms, the relations around them and the evidence of these."""
    ids = with_synonyms(x, seeds, limits.synonyms) if synonyms else seeds.select("query_id", "entity_id").distinct()
    return entity_bundle(x, ids, wanted, limits.graph_relations, limits.graph_chunks)


def relation_bundle(x: Tables, hits: DataFrame, chunks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, chunks) of a set of relations: both ends, the relations themselves, their evidence."""
    own = hits.select("query_id", "relation_id").distinct().join(x.relations, "relation_id")
    ends = own.select("query_id", F.explode(F.array("subject_entity_id", "object_entity_id")).alias("entity_id")).distinct()
    entities = ends.join(x.entities.select("entity_id"), "entity_id", "left_semi").select("query_id", "entity_id", F.lit(1.0).alias("score"))
    return entities, own.select("query_id", "relation_id", F.col("confidence").alias("score")), first(g.evidence_chunks(x.links, own, x.chunks), "chunk_id", chunks)


def expand_relations(x: Tables, hits: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Expansion from relations: their ends, the relations around those of any type, and the hits' own evidence."""
    entities, own, chunks = relation_bundle(x, hits, limits.graph_chunks)
    around = first(g.relations_touching(x.relations, entities).withColumn("score", F.col("confidence")), "relation_id", limits.graph_relations)
    return entities, best([own, around], "relation_id"), chunks


def end_specificity(x: Tables, hits: DataFrame) -> DataFrame:
    """Relation hits times the larger specificity of their ends."""
    df = g.document_frequency(x.mentions)
    own = hits.join(x.relations.select("relation_id", "subject_entity_id", "object_entity_id", "relation_type"), "relation_id")
    value = lambda c: F.greatest(1 / F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)).cast("double"), F.lit(1e-6))
    for end in ("subject", "object"):
        own = own.join(df.select(F.col("entity_id").alias(f"{end}_entity_id"), F.col("n_chunks").alias(f"__{end}")), f"{end}_entity_id", "left")
    return own.withColumn("score", F.col("score") * F.greatest(value(F.col("__subject")), value(F.col("__object")))).drop("__subject", "__object")


def disease_names(x: Tables, candidates: DataFrame) -> DataFrame:
    return candidates.join(x.entities.select("entity_id", "name"), "entity_id")


def boosted(x: Tables, hits: DataFrame, relations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Chunk hits with what a query's disease candidates add.

    A candidate's score counts for each of its relations that a chunk is evidence of (of a relation between two candidates
    the subject counts), and 0.35 of it where the chunk's title, section or first 800 characters hold its name. Names meet
    only the chunks of their own query.
    """
    kinds = x.entities.filter("entity_type = 'BENH_LY'").select("entity_id")
    scored = candidates.select("query_id", "entity_id", F.col("score").alias("__d"))
    side = lambda end: scored.join(kinds, "entity_id", "left_semi").select("query_id", F.col("entity_id").alias(f"{end}_entity_id"), F.col("entity_id").alias(f"__{end}"), F.col("__d").alias(f"__{end}_d"))
    own = relations.select("query_id", "relation_id").join(x.relations.select("relation_id", "subject_entity_id", "object_entity_id"), "relation_id")
    own = own.join(side("subject"), ["query_id", "subject_entity_id"], "left").join(side("object"), ["query_id", "object_entity_id"], "left")
    own = own.select("query_id", "relation_id", F.coalesce("__subject", "__object").alias("entity_id"), F.when(F.col("__subject").isNotNull(), F.col("__subject_d")).otherwise(F.col("__object_d")).alias("__d")).filter("entity_id is not null")
    by_evidence = own.join(x.links, "relation_id").groupBy("query_id", "chunk_id").agg(F.sum("__d").alias("__evidence"))
    named = disease_names(x, own.select("query_id", "entity_id", "__d").distinct()).select("query_id", t.fold_alnum("name").alias("__name"), "__d").filter("__name <> ''")
    per_query = named.groupBy("query_id").agg(F.collect_list(F.struct("__name", "__d")).alias("__names"))  # at most a query's candidates
    texts = x.chunks.select("chunk_id", t.fold_alnum(F.concat_ws(" ", "title", "section", F.substring("text", 1, 800))).alias("__text"))
    met = hits.join(texts, "chunk_id").join(per_query, "query_id", "left").join(by_evidence, ["query_id", "chunk_id"], "left")
    by_name = F.aggregate(F.coalesce("__names", F.array().cast("array<struct<__name:string,__d:double>>")), F.lit(0.0), lambda s, n: s + F.when(F.col("__text").contains(n["__name"]), n["__d"] * 0.35).otherwise(0.0))
    return met.select("query_id", "chunk_id", (F.col("score") + F.coalesce("__evidence", F.lit(0.0)) + by_name).alias("score"))


def light(x: Tables, asked: DataFrame, entity_hits: DataFrame, relation_hits: DataFrame, limits: Limits = Limits()) -> dict[str, DataFrame]:
    """Two-level retrieval: entities for the low keywords, relations for the high ones, and the graph around both.

    asked: query_id, intent, types (``keywords.understood``). Hits are weighed by specificity; relation hits must be of a
    type that the question asks for and touch an entity hit, unless that leaves a question none. For symptom questions
    diseases are ranked first, the graph around the best ones is added, and chunks are raised by them.
    """
    stage = Stage(asked.sparkSession, "light")
    seeds = stage.write(g.specificity(entity_hits, g.document_frequency(x.mentions)).select("query_id", "entity_id", "score"), "seeds")
    typed = of_types(relation_hits.join(x.relations, "relation_id"), asked)
    ends = typed.select("query_id", "relation_id", F.explode(F.array("subject_entity_id", "object_entity_id")).alias("entity_id"))
    touched = ends.join(seeds, ["query_id", "entity_id"], "left_semi").select("query_id", "relation_id", F.lit(True).alias("keep")).distinct()
    flagged = typed.select("query_id", "relation_id", "score").join(touched, ["query_id", "relation_id"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
    hits = stage.write(end_specificity(x, r.filter_or_all(flagged, "keep").select("query_id", "relation_id", "score")).select("query_id", "relation_id", "score"), "hits")
    a = [stage.write(d, "a") for d in expand_entities(x, seeds, asked, limits)]
    b = [stage.write(d, "b") for d in expand_relations(x, hits, limits)]
    base = stage.write(best([hits, a[1], b[1]], "relation_id"), "base")
    symptom = asked.filter("intent = 'symptom_diagnosis'").select("query_id")
    asked_for = base.join(symptom, "query_id", "left_semi").join(x.relations.drop("confidence"), "relation_id")
    candidates = stage.write(r.disease_candidates(asked_for, x.entities, seeds), "candidates")
    top = first(candidates, "entity_id", limits.diseases)
    c = [stage.write(d, "c") for d in expand_entities(x, top, asked, limits)]
    relations = stage.write(best([base, c[1]], "relation_id"), "relations")
    chunks = best([a[2], b[2], c[2]], "chunk_id")
    return {
        "entities": first(best([seeds, a[0], b[0], c[0]], "entity_id"), "entity_id", limits.max_entities),
        "relations": first(relations, "relation_id", limits.max_relations),
        "chunks": first(boosted(x, chunks, relations, candidates), "chunk_id", limits.max_chunks),
        "candidates": candidates,
    }


def associative(x: Tables, lexical: DataFrame, vectors: DataFrame, limits: Limits = Limits()) -> dict[str, DataFrame]:
    """Associative retrieval: personalized PageRank from lexical and vector seeds over the graph around them.

    A question whose seeds have no relations near them walks over nothing and keeps its seeds' own scores.
    """
    stage = Stage(lexical.sparkSession, "associative")
    raw = best([lexical, vectors], "entity_id").filter("score > 0")
    seeds = stage.write(r.normalized(g.specificity(raw, g.document_frequency(x.mentions))), "seeds")
    edges = stage.write(g.induced(x.relations, g.neighbourhood(x.relations, seeds, limits.hops)), "edges")
    ranks = stage.write(r.pagerank(seeds, edges, iterations=limits.iterations, tolerance=limits.tolerance), "ranks")
    top = stage.write(first(ranks, "entity_id", limits.ranked_entities), "top")
    touching = g.relations_touching(x.relations, top).withColumn("score", F.col("confidence"))
    kept = first(touching, "relation_id", limits.graph_relations).drop("score").join(x.relations, "relation_id")
    relations = stage.write(r.relation_scores(kept, ranks).select("query_id", "relation_id", "score"), "relations")
    scored = r.chunk_scores(x.mentions, top, relations, x.links)
    wide = first(scored, "chunk_id", 3 * limits.max_chunks)
    return {
        "entities": top.join(x.entities.select("entity_id"), "entity_id", "left_semi").select("query_id", "entity_id", "score"),
        "relations": first(relations, "relation_id", limits.graph_relations),
        "chunks": first(wide.join(x.chunks.select("chunk_id"), "chunk_id", "left_semi"), "chunk_id", limits.max_chunks),
    }


def support(x: Tables, chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``chunks`` with the ids of a query's entities that they mention and of its relations that they are evidence of, sorted."""
    e = chunks.join(x.mentions.select("chunk_id", "entity_id"), "chunk_id").join(entities.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_semi").groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    q = chunks.join(x.links, "chunk_id").join(relations.filter("score > 0").select("query_id", "relation_id"), ["query_id", "relation_id"], "left_semi").groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_set("relation_id")).alias("relation_ids"))
    none = F.array().cast("array<string>")
    return chunks.join(e, ["query_id", "chunk_id"], "left").join(q, ["query_id", "chunk_id"], "left").withColumns({"entity_ids": F.coalesce("entity_ids", none), "relation_ids": F.coalesce("relation_ids", none)})


def mixed(branches: dict[str, DataFrame], limits: Limits = Limits(), k: int = 60) -> DataFrame:
    """(query_id, chunk_id, score, branches, best_score): reciprocal rank fusion of the branches' chunks."""
    parts = [d.select("query_id", "chunk_id", F.col("score").cast("double").alias("score"), F.lit(name).alias("branch")) for name, d in branches.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = r.reciprocal_rank_fusion(both, "chunk_id", k)
    return g.top_per_query(fused, limits.max_chunks, F.round("score", 9).desc(), F.asc("chunk_id")).drop("rank")


def record_lines(entities: DataFrame) -> Column:
    """Name, type and profile (or description) of an entity on one line."""
    said = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("profile_text", "description") if c in entities.columns], F.lit(""))
    return F.concat(F.lit("- "), F.coalesce("name", F.lit("")), F.lit(" ("), F.coalesce("entity_type", F.lit("")), F.lit(")"), F.when(said != "", F.concat(F.lit(": "), said)).otherwise(""))


def relation_lines() -> Column:
    """A relation with its ends' names, and what is said of it, on lines of their own."""
    labelled = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    head = F.concat(F.lit("- "), F.coalesce("subject_name", F.lit("")), F.lit(" -["), F.coalesce("relation_type", F.lit("")), F.lit("]-> "), F.coalesce("object_name", F.lit("")))
    return F.concat_ws("\n", head, labelled("  Mô tả: ", F.col("description")), labelled("  Keywords: ", F.array_join("keywords", ", ")), labelled("  Evidence: ", F.col("evidence_text")))


def chunk_lines() -> Column:
    """A chunk under its id, title and section; the text in context where there is one."""
    more = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(" | "), c)).otherwise("") for c in (F.col("section"), F.col("subsection"))]
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Unknown title"))
    return F.concat(F.lit("[Chunk "), "chunk_id", F.lit("] "), title, *more, F.lit("\n"), F.coalesce(F.nullif(F.col("contextualized_text"), F.lit("")), F.col("text"), F.lit("")))


def evidence_lines() -> Column:
    """A chunk as the answer and the judge get it: numbered, its own text first; null if it has no text."""
    body = F.trim(F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("contextualized_text"), F.lit("")))
    named = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{n}="), c)) for n, c in (("title", F.col("title")), ("section", F.col("section")))]
    head = F.concat_ws(" | ", F.concat(F.lit("[Context "), F.col("rank").cast("string"), F.lit("]")), F.concat(F.lit("chunk_id="), "chunk_id"), *named)
    return F.when(body != "", F.concat(head, F.lit("\n"), body))


def listed(rows: DataFrame, line: Column, n: int, between: str = "\n") -> DataFrame:
    """(query_id, lines): the lines of a query's first n records in order of rank."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return rows.filter(F.col("rank") <= n).groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda z: z["line"]), between).alias("lines"))


def context(asked: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(query_id, context): keywords, entities, relations and chunks of each question under headings; empty parts are left out.

    The record tables have query_id, rank and the record's columns.
    """
    none = F.lit("(none)")
    words = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), none)
    out = asked.select("query_id", F.concat(F.lit("## Query keywords\nLow-level: "), words("low"), F.lit("\nHigh-level: "), words("high")).alias("__0"))
    parts = (("## Entities\n", entities, record_lines(entities), limits.max_entities, "\n"), ("## Relations\n", relations, relation_lines(), limits.max_relations, "\n"), ("## Source chunks\n", chunks, chunk_lines(), limits.max_chunks, "\n\n"))
    for i, (heading, rows, line, n, between) in enumerate(parts, 1):
        lines = listed(rows, line, n, between).select("query_id", F.concat(F.lit(heading), "lines").alias(f"__{i}"))
        out = out.join(lines, "query_id", "left")
    return out.select("query_id", F.concat_ws("\n\n", "__0", "__1", "__2", "__3").alias("context"))
