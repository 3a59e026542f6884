"""Scores over results: personalized PageRank, rank fusion, merges and disease candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phloem.storage import Stage


def normalized(scores: DataFrame, key: str = "entity_id") -> DataFrame:
    """Positive scores of each query, brought to sum 1."""
    positive = scores.filter((F.col("score") > 0) & F.col(key).isNotNull())
    totals = positive.groupBy("query_id").agg(F.sum("score").alias("__total"))
    return positive.join(totals, "query_id").select("query_id", key, (F.col("score") / F.col("__total")).alias("score"))


def pagerank(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-7, undirected: bool = True) -> DataFrame:
    """(query_id, entity_id, score): personalized PageRank of each query's subgraph, all queries in one loop.

    seeds (query_id, entity_id, score), edges (query_id, source, target, weight). Parallel edges add up, undirected ones
    count both ways (a loop twice), weights that are null are 1, those not above 0 are dropped. Nodes without outgoing
    weight give their rank back to the seeds. A query stops after ``iterations``, or once its own ranks together move by
    no more than ``tolerance``, so its result does not depend on the batch it is in. Edges are normalised and written once; every iteration's ranks are written to the
    shared folder, so the lineage is one iteration deep.
    """
    stage = Stage(seeds.sparkSession, "pagerank")
    d = min(max(damping, 0.0), 1.0)
    forward = edges.select("query_id", "source", "target", F.coalesce("weight", F.lit(1.0)).alias("weight")).filter("weight > 0 and source is not null and target is not null")
    pairs = forward.unionByName(forward.select("query_id", F.col("target").alias("source"), F.col("source").alias("target"), "weight")) if undirected else forward
    summed = pairs.groupBy("query_id", "source", "target").agg(F.sum("weight").alias("weight"))
    out = summed.groupBy("query_id", "source").agg(F.sum("weight").alias("__out"))
    steps = stage.write(summed.join(out, ["query_id", "source"]).select("query_id", "source", "target", (F.col("weight") / F.col("__out")).alias("part")), "steps")
    start = stage.write(normalized(seeds.groupBy("query_id", "entity_id").agg(F.max("score").alias("score"))).select("query_id", "entity_id", F.col("score").alias("p")), "start")
    sources = steps.select("query_id", F.col("source").alias("entity_id")).distinct()
    rank = start.select("query_id", "entity_id", F.col("p").alias("score"))
    ended: list[DataFrame] = []
    for _ in range(max(1, iterations)):
        moved = steps.join(rank.withColumnRenamed("entity_id", "source"), ["query_id", "source"]).groupBy("query_id", F.col("target").alias("entity_id")).agg(F.sum(F.col("part") * F.col("score")).alias("got"))
        sunk = rank.join(sources, ["query_id", "entity_id"], "left_anti").groupBy("query_id").agg(F.sum("score").alias("sunk"))
        back = start.join(sunk, "query_id", "left").select("query_id", "entity_id", (F.col("p") * (1 - d + d * F.coalesce("sunk", F.lit(0.0)))).alias("back"))
        joined = moved.join(back, ["query_id", "entity_id"], "full").select("query_id", "entity_id", (d * F.coalesce("got", F.lit(0.0)) + F.coalesce("back", F.lit(0.0))).alias("score"))
        following = stage.write(joined, "rank")
        if tolerance > 0:
            both = following.alias("n").join(rank.alias("o"), ["query_id", "entity_id"], "full")
            delta = both.groupBy("query_id").agg(F.sum(F.abs(F.coalesce("n.score", F.lit(0.0)) - F.coalesce("o.score", F.lit(0.0)))).alias("d"))
            still = stage.write(delta.filter(F.col("d") > tolerance).select("query_id"), "still")
            settled = stage.write(following.join(still, "query_id", "left_anti"), "settled")
            if settled.limit(1).count():
                ended.append(settled)
                start = stage.write(start.join(still, "query_id", "left_semi"), "start")
                following = stage.write(following.join(still, "query_id", "left_semi"), "rank")
            if not still.limit(1).count():
                rank = following
                break
        stage.drop(rank)
        rank = following
    for e in ended:
        rank = rank.unionByName(e)
    return rank.filter("score > 0")


def relation_scores(touching: DataFrame, ranks: DataFrame) -> DataFrame:
    """A query's relations, scored by the larger rank of their ends times their confidence."""
    end = lambda c: ranks.select("query_id", F.col("entity_id").alias(c), F.col("score").alias(f"__{c}"))
    both = touching.join(end("subject_entity_id"), ["query_id", "subject_entity_id"], "left").join(end("object_entity_id"), ["query_id", "object_entity_id"], "left")
    top = F.greatest(F.coalesce("__subject_entity_id", F.lit(0.0)), F.coalesce("__object_entity_id", F.lit(0.0)))
    return both.withColumn("score", top * F.col("confidence")).drop("__subject_entity_id", "__object_entity_id")


def chunk_scores(ment: DataFrame, ranks: DataFrame, scored_relations: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): ranks of mentioned entities by confidence, plus scores of relations it is evidence of."""
    a = ment.join(ranks.filter("score > 0"), "entity_id").select("query_id", "chunk_id", (F.col("score") * F.col("confidence")).alias("score"))
    b = links.join(scored_relations.filter("score > 0").select("query_id", "relation_id", "score"), "relation_id").select("query_id", "chunk_id", "score")
    return a.unionByName(b).groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))


def max_merge(results: DataFrame, key: str) -> DataFrame:
    """Results of several branches: of each query and key the row with the best score, the first branch on ties."""
    w = Window.partitionBy("query_id", key).orderBy(F.col("score").desc_nulls_last(), "branch")
    return results.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def reciprocal_rank_fusion(results: DataFrame, key: str, k: int = 60) -> DataFrame:
    """(query_id, key, score, branches, best_score): sum over branches of 1 / (k + rank); ranks by score, then key."""
    w = Window.partitionBy("query_id", "branch").orderBy(F.col("score").desc_nulls_last(), key)
    ranked = results.withColumn("__r", F.row_number().over(w))
    return ranked.groupBy("query_id", key).agg(F.sum(1.0 / (k + F.col("__r"))).alias("score"), F.array_sort(F.collect_set("branch")).alias("branches"), F.max("score").alias("best_score"))


def filter_or_all(rows: DataFrame, keep: str) -> DataFrame:
    """Of each query the rows with the flag, or all of its rows if none has it."""
    flags = rows.groupBy("query_id").agg(F.max(F.col(keep).cast("int")).alias("__any"))
    return rows.join(flags, "query_id").filter(F.col(keep) | (F.col("__any") == 0)).drop("__any")


# What a relation counts for a disease candidate.
RELATION_WEIGHTS = {"CO_BIEU_HIEN": 2.4, "LIEN_QUAN_YEU_TO": 1.2, "ANH_HUONG_DEN": 0.8, "CHAN_DOAN_PHAN_BIET_VOI": 0.6}


def disease_candidates(relations: DataFrame, entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, entity_id, score): diseases at the ends of a query's relations.

    Each relation counts max(score, 0.05) times its type's weight, times 1.8 if its other end is a seed and 0.65 if not;
    several relations reinforce one another up to the fourth. relations: query_id, ends, relation_type, score.
    """
    kinds = entities.select("entity_id", "entity_type")
    typed = relations.join(kinds.select(F.col("entity_id").alias("subject_entity_id"), F.col("entity_type").alias("__s")), "subject_entity_id")
    typed = typed.join(kinds.select(F.col("entity_id").alias("object_entity_id"), F.col("entity_type").alias("__o")), "object_entity_id")
    weight = F.coalesce(*[F.when(F.col("relation_type") == t, F.lit(w)) for t, w in RELATION_WEIGHTS.items()])
    first = F.col("__s") == "BENH_LY"
    picked = typed.withColumn("__w", weight).filter(F.col("__w").isNotNull() & (first | (F.col("__o") == "BENH_LY")))
    picked = picked.select("query_id", F.when(first, F.col("subject_entity_id")).otherwise(F.col("object_entity_id")).alias("entity_id"), F.when(first, F.col("object_entity_id")).otherwise(F.col("subject_entity_id")).alias("__far"), "score", "__w")
    met = picked.join(seeds.select("query_id", F.col("entity_id").alias("__far"), F.lit(True).alias("__hit")).distinct(), ["query_id", "__far"], "left")
    part = F.greatest("score", F.lit(0.05)) * F.col("__w") * F.when(F.col("__hit"), 1.8).otherwise(0.65)
    summed = met.groupBy("query_id", "entity_id").agg(F.sum(part).alias("s"), F.count("*").alias("n"))
    return summed.select("query_id", "entity_id", (F.col("s") * (1 + F.least("n", F.lit(4)) * 0.12)).alias("score"))
