"""Pairwise matches consolidated into groups: minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phloem.storage import Stage


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct links (a, b) with a < b; nulls and links of an id with itself drop out."""
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (F.col(a).isNull() | F.col(b).isNull()).alias("__n")).filter(
        "not __n and a <> b"
    ).drop("__n").distinct()


def _jump(stage: Stage, pointers: DataFrame, changed: int) -> DataFrame:
    """Pointer jumping: node -> p(p(node)) until every pointer names a root. Each jump halves the depth."""
    while changed:
        up = pointers.select(F.col("node").alias("p"), F.col("parent").alias("pp")).filter("p <> pp")
        following = stage.write(
            pointers.alias("x").join(up.alias("y"), F.col("x.parent") == F.col("y.p"), "left").select(
                "node", F.coalesce("y.pp", "x.parent").alias("parent"), F.col("y.pp").isNotNull().alias("moved")
            ),
            "jump",
        )
        changed = following.filter("moved").limit(1).count()
        stage.drop(pointers)
        pointers = following
    return pointers.select("node", "parent")


def connected_groups(edges: DataFrame, a: str, b: str, node: str = "node", group: str = "group_id") -> DataFrame:
    """(node, group): every id linked to at least one different id, with the smallest id of its component.

    Links have no direction; repeated links, links with a null end and links of an id with itself change nothing. An
    empty input gives no rows. Further columns of ``edges`` are ignored.

    Each round, over links between the labels so far: every label takes the smallest label among itself and its
    neighbours (a partial aggregate, so a hub's links are combined before the shuffle), pointer jumping makes every
    label name a root, and the links are rewritten to the roots, which drops those inside one group. A round at least
    halves the labels of a star or a chain; the loop ends when no link is left, that is when no label would change.
    Each round's tables are written to the shared folder: the lineage stays one round deep and an executor may be lost
    at any time. Nothing but counts of remaining links reaches the driver. The rewriting join's large side may hold a
    hub; it is the side that AQE splits, as the other one has one row a label.
    """
    spark = edges.sparkSession
    stage = Stage(spark, "groups")
    links = stage.write(undirected(edges, a, b), "links")
    labels = stage.write(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("label", F.col("node")), "labels")
    left = links.limit(1).count()
    while left:
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        hooks = stage.write(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("parent")), "hooks")
        roots = _jump(stage, hooks, 1)
        to = lambda side: roots.select(F.col("node").alias(side), F.col("parent").alias(f"r{side}"))
        fresh = stage.write(undirected(links.join(to("a"), "a").join(to("b"), "b"), "ra", "rb"), "links")
        renamed = stage.write(
            labels.join(roots.select(F.col("node").alias("label"), "parent"), "label", "left").select("node", F.coalesce("parent", "label").alias("label")),
            "labels",
        )
        stage.drop(links, labels, hooks)
        links, labels = fresh, renamed
        left = links.limit(1).count()
    return labels.select(F.col("node").alias(node), F.col("label").alias(group))


def synonym_links(relations: DataFrame, relation_type: str = "DONG_NGHIA_VOI") -> DataFrame:
    """Rows of a relation table of one type, read without case and outer blanks."""
    kind: Column = F.upper(F.regexp_replace("relation_type", r"(?U)^\s+|\s+$", ""))
    return relations.filter(kind == relation_type).select("subject_entity_id", "object_entity_id")
