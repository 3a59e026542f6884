"""The property graph as tables: current nodes, merged relations, evidence, mentions, lookups, neighbours and k-hop subgraphs.

Everything that answers a query is keyed by query_id, so a batch of queries is one plan. Hot keys: per-key merges are
aggregates whose map side combines; joins on a hub's id have one row a key on the other side and are split by AQE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phloem.storage import Stage


def latest(df: DataFrame, key: str, seen_at: str, *ties: str) -> DataFrame:
    """Last writer wins: of each key the row with the largest ``seen_at`` (null as earliest), then the smallest ``ties``."""
    order = [F.col(seen_at).desc_nulls_last(), *[F.col(t).asc_nulls_first() for t in ties]]
    ranked = df.filter(F.col(key).isNotNull()).withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter("__rank = 1").drop("__rank")


def live(df: DataFrame, deleted_at: str = "deleted_at") -> DataFrame:
    return df.filter(F.col(deleted_at).isNull())


def current_entities(entities: DataFrame) -> DataFrame:
    return latest(live(entities), "entity_id", "ingested_at", "name", "mention_count")


def current_chunks(chunks: DataFrame) -> DataFrame:
    return latest(live(chunks), "chunk_id", "ingested_at", "text", "token_count")


def current_articles(articles: DataFrame) -> DataFrame:
    return latest(live(articles), "article_id", "ingested_at", "body", "url")


def evidence_links(relations: DataFrame) -> DataFrame:
    """(relation_id, chunk_id), distinct: evidence ids without outer blanks, null and blank ones dropped."""
    each = relations.select("relation_id", F.explode("evidence_chunk_ids").alias("c")).select("relation_id", F.regexp_replace("c", r"^\s+|\s+$", "").alias("chunk_id"))
    return each.filter("chunk_id <> '' and relation_id is not null").distinct()


def relation_kind(c: str = "relation_type") -> Column:
    return F.upper(F.trim(F.col(c)))


def merged_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """One row a relation whose ends both exist: first non-empty texts by time, largest confidence within 0..1, else 1."""

    def said(c: str) -> Column:
        there = F.trim(F.coalesce(c, F.lit(""))) != ""
        return F.min(F.when(there, F.struct("ingested_at", F.col(c).alias("text")))).getField("text").alias(c)

    merged = (
        relations.filter("relation_id is not null")
        .groupBy("relation_id")
        .agg(
            F.min("subject_entity_id").alias("subject_entity_id"),
            F.min("object_entity_id").alias("object_entity_id"),
            F.min(relation_kind()).alias("relation_type"),
            F.coalesce(F.max(F.when(F.col("confidence").between(0, 1), F.col("confidence"))), F.lit(1.0)).alias("confidence"),
            *[said(c) for c in ("description", "evidence_text", "section", "source_url")],
        )
    )
    ids = entities.select("entity_id")
    return merged.join(ids, merged.subject_entity_id == ids.entity_id, "left_semi").join(ids, merged.object_entity_id == ids.entity_id, "left_semi")


def mentions(relations: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, entity_id, confidence): entities that a chunk is evidence about; the largest confidence of its relations."""
    both = links.join(relations, "relation_id").select("chunk_id", F.explode(F.array("subject_entity_id", "object_entity_id")).alias("entity_id"), "confidence")
    return both.groupBy("chunk_id", "entity_id").agg(F.max("confidence").alias("confidence")).join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def both_ways(relations: DataFrame) -> DataFrame:
    """Each relation from either end: (relation_id, entity_id, neighbour_id, relation_type, confidence)."""
    out = relations.select("relation_id", F.col("subject_entity_id").alias("entity_id"), F.col("object_entity_id").alias("neighbour_id"), "relation_type", "confidence")
    back = relations.select("relation_id", F.col("object_entity_id").alias("entity_id"), F.col("subject_entity_id").alias("neighbour_id"), "relation_type", "confidence")
    return out.unionByName(back.filter("entity_id <> neighbour_id"))


def top_per_query(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each query; where n is small Spark limits each map task's rows before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


def lookup(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose column is in a table of wanted values, by a semi join."""
    return df.join(wanted.select(F.col(wanted.columns[0]).alias("__w")).distinct(), F.col(column) == F.col("__w"), "left_semi")


def optional_filter(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """All rows if no values are named, else those with one of them."""
    return df if values is None else df.filter(F.col(column).isin(values))


def chunks_of_entities(ment: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): how many of a query's seed entities a chunk mentions."""
    return ment.join(seeds.select("query_id", "entity_id").distinct(), "entity_id").groupBy("query_id", "chunk_id").agg(F.count("*").alias("score"))


def neighbours(relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, entity_id, score): neighbours of a query's seeds in either direction, by number of relations."""
    met = both_ways(relations).join(seeds.select("query_id", "entity_id").distinct(), "entity_id")
    return met.groupBy("query_id", F.col("neighbour_id").alias("entity_id")).agg(F.count("*").alias("score"))


def synonym_neighbours(relations: DataFrame, entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """Synonyms of a query's seeds that are of the seed's type: (query_id, entity_id, score, mention_count), best confidence."""
    kinds = entities.select("entity_id", "entity_type", F.coalesce("mention_count", F.lit(0)).alias("mention_count"))
    met = both_ways(relations.filter("relation_type = 'DONG_NGHIA_VOI'")).join(seeds.select("query_id", "entity_id").distinct(), "entity_id")
    typed = met.join(kinds.select("entity_id", F.col("entity_type").alias("own")), "entity_id").drop("entity_id")
    far = typed.join(kinds, typed.neighbour_id == kinds.entity_id).filter("own = entity_type")
    return far.groupBy("query_id", "entity_id").agg(F.max("confidence").alias("score"), F.max("mention_count").alias("mention_count"))


def relations_touching(relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """A query's relations with a seed at either end, each once: a join from each end and a union, not a disjunctive join."""
    ids = seeds.select("query_id", F.col("entity_id").alias("__e")).distinct()
    ends = [relations.join(ids, relations[c] == ids["__e"]).select("query_id", "relation_id") for c in ("subject_entity_id", "object_entity_id")]
    return ends[0].union(ends[1]).distinct().join(relations, "relation_id")


def evidence_chunks(links: DataFrame, wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): existing chunks by how many of a query's relations they are evidence of."""
    counted = links.join(wanted.select("query_id", "relation_id").distinct(), "relation_id").groupBy("query_id", "chunk_id").agg(F.count("*").alias("score"))
    return counted.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def neighbourhood(relations: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(query_id, entity_id): seeds and all within ``hops`` steps of them in either direction.

    Each hop's new nodes are written, so a hop reads the one before and never computes it again.
    """
    if hops not in (1, 2, 3):
        raise ValueError("hops must be 1, 2 or 3")
    stage = Stage(relations.sparkSession, "hops")
    edges = stage.write(both_ways(relations).select("entity_id", "neighbour_id").distinct(), "edges")
    frontier = reached = stage.write(seeds.select("query_id", "entity_id").distinct(), "seeds")
    for _ in range(hops):
        step = frontier.join(edges, "entity_id").select("query_id", F.col("neighbour_id").alias("entity_id")).distinct()
        frontier = stage.write(step.join(reached, ["query_id", "entity_id"], "left_anti"), "frontier")
        reached = reached.union(frontier)
    return reached


def induced(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, relation_id, source, target, weight): relations with both ends among a query's nodes."""
    one = nodes.select("query_id", F.col("entity_id").alias("subject_entity_id"))
    two = nodes.select("query_id", F.col("entity_id").alias("object_entity_id"))
    inside = relations.join(one, "subject_entity_id").join(two, ["query_id", "object_entity_id"])
    return inside.select("query_id", "relation_id", F.col("subject_entity_id").alias("source"), F.col("object_entity_id").alias("target"), F.col("confidence").alias("weight"))


def document_frequency(ment: DataFrame) -> DataFrame:
    """(entity_id, n_chunks): mentions are distinct by chunk and entity already."""
    return ment.groupBy("entity_id").agg(F.count("*").alias("n_chunks"))


def specificity(scored: DataFrame, frequency: DataFrame, least: float = 1e-6) -> DataFrame:
    """Scores times one over the number of chunks that mention the entity; an unmentioned one keeps its score."""
    value = F.greatest(1 / F.greatest(F.coalesce("n_chunks", F.lit(1)), F.lit(1)).cast("double"), F.lit(least))
    return scored.join(frequency, "entity_id", "left").withColumn("specificity", value).withColumn("score", F.col("score") * F.col("specificity")).drop("n_chunks")


def graph_stats(articles: DataFrame, chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of the four true counts; an empty table is 0."""
    names = ("articles", "chunks", "entities", "relations")
    each = [df.agg(F.lit(n).alias("t"), F.count("*").alias("n")) for df, n in zip((articles, chunks, entities, relations), names)]
    return reduce(DataFrame.union, each).agg(*[F.max(F.when(F.col("t") == n, F.col("n"))).alias(n) for n in names])


#: Questions of one lexical batch.
MAX_QUESTIONS = 4096


def with_names(relations: DataFrame, entities: DataFrame, *columns: str) -> DataFrame:
    """Relations with columns of their ends, as subject_... and object_...; ``name`` and ``entity_type`` (as ..._type) come always."""
    each = {"name": "name", "entity_type": "type"} | {c: c for c in columns}
    end = lambda p: entities.select(F.col("entity_id").alias(f"{p}_entity_id"), *[F.col(c).alias(f"{p}_{n}") for c, n in each.items()])
    return relations.join(end("subject"), "subject_entity_id").join(end("object"), "object_entity_id")


def lexical_scores(texts: DataFrame, rows: DataFrame, weights: dict[str, int], id_col: str, block: int = 256) -> DataFrame:
    """(query_id, id, score > 0): the weights of the fields that hold a query's text, in lower case.

    A field is a string, or an array of which any element counts; nulls hold nothing, and blank texts ask for nothing.
    ``texts`` (query_id, text) is a batch of at most MAX_QUESTIONS questions, more is an error: it goes through in blocks
    of literals, so the rows are scanned once a block and nothing is joined.
    """
    kinds = dict(rows.dtypes)
    asked = [(r["query_id"], r["q"]) for r in texts.select("query_id", F.lower(F.trim("text")).alias("q")).filter("q <> ''").limit(MAX_QUESTIONS + 1).collect()]
    if len(asked) > MAX_QUESTIONS:
        raise ValueError(f"a batch holds at most {MAX_QUESTIONS} questions")
    asked.sort(key=lambda x: str(x[0]))
    if not asked:
        return rows.select(F.lit(None).cast(dict(texts.dtypes)["query_id"]).alias("query_id"), F.col(id_col), F.lit(0).alias("score")).filter("false")

    def hit(field: str, q: Column) -> Column:
        if kinds[field].startswith("array"):
            return F.exists(F.coalesce(F.col(field), F.array().cast("array<string>")), lambda x: F.lower(x).contains(q))
        return F.lower(F.coalesce(F.col(field), F.lit(""))).contains(q)

    parts = []
    for start in range(0, len(asked), block):
        some = F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(q).alias("q")) for i, q in asked[start : start + block]])
        each = rows.select(id_col, *dict.fromkeys(weights), F.explode(some).alias("__a"))
        score = sum((F.when(F.coalesce(hit(f, F.col("__a.q")), F.lit(False)), F.lit(w)).otherwise(F.lit(0)) for f, w in weights.items()), F.lit(0))
        parts.append(each.select(F.col("__a.query_id").alias("query_id"), F.col(id_col), score.alias("score")).filter("score > 0"))
    return reduce(DataFrame.union, parts)


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row holds: what a uniqueness constraint would refuse."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")

