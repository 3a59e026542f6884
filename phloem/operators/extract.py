"""Validation of extracted entities and relations: names, schema, evidence, synonyms, duplicates, missing ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phloem import schema
from phloem.functions import text as t

# Folded hints of names that are no entities.
BLOCKED = (
    "benh vien", "phong kham", "hotline", "fanpage", "website", "dat lich", "bac si", "thac si", "tien si", "ts.bs", "bs.", "dia chi",
    "copyright", "doi_tuong", "benh_ly", "bieu_hien_lam_sang", "dau hieu", "trieu chung", "nguyen nhan", "bien chung", "dieu tri",
    "phong ngua", "chan doan",
)
# How questions start.
QUESTION_STARTS = ("khi nào", "vì sao", "tại sao", "làm gì", "làm thế nào", "có nên", "có cần", "bao lâu", "bao nhiêu", "ai", "ở đâu")
# Folded cues for and against synonymy.
SYNONYM_FOR = ("con goi la", "con duoc goi la", "hay goi la", "con co ten la", "ten khac la", "ten goi khac", "tieng anh la", "ten tieng anh", "viet tat la", "aka", "also known as")
SYNONYM_AGAINST = ("la dang cua", "la mot dang", "la the cua", "la mot the", "la loai", "la mot loai", "phan loai", "bao gom cac the", "cac dang")


def blocked(name: Column) -> Column:
    return t.let(t.folded(name), lambda x: t.holds_any(x, BLOCKED))  # the hints are ASCII, so folding loses none


def bad_name(name: Column) -> Column:
    words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    return t.let(name, lambda x: F.coalesce(x.isNull() | (F.length(x) < 2) | ((F.length(x) >= 25) & (words(x) > 12)) | blocked(x), F.lit(True)))


def question_only(evidence: Column) -> Column:
    return t.let(F.lower(F.trim(evidence)), lambda text: F.coalesce((text == "") | text.rlike(r"\?|^(?:" + "|".join(QUESTION_STARTS) + ")"), F.lit(True)))


def parenthetical(evidence: Column, a: Column, b: Column) -> Column:
    """Whether the folded evidence names one right after the other in brackets; names are data, so no pattern is built of them."""
    tight = F.regexp_replace(F.regexp_replace(t.fold(evidence), r"\s*\(\s*", "("), r"\s*\)", ")")
    x, y = t.fold(a), t.fold(b)
    return (x != "") & (y != "") & (tight.contains(F.concat(x, F.lit("("), y, F.lit(")"))) | tight.contains(F.concat(y, F.lit("("), x, F.lit(")"))))


def synonym_valid(subject: Column, subject_type: Column, object_: Column, object_type: Column, evidence: Column) -> Column:
    said = t.fold(evidence)
    return (subject_type == object_type) & (t.fold(subject) != t.fold(object_)) & ~t.contains_any(said, SYNONYM_AGAINST) & (t.contains_any(said, SYNONYM_FOR) | parenthetical(evidence, subject, object_))


def valid_entities(entities: DataFrame, seq: str) -> DataFrame:
    """(key, entity_type, name, description, evidence_text): one row a folded name and type: first name, first non-empty texts by ``seq``."""
    named = entities.withColumn("name", t.display_name("name")).withColumn("entity_type", F.trim("entity_type"))
    good = named.filter(F.col("entity_type").isin(list(schema.ENTITY_TYPES)) & ~bad_name(F.col("name")))
    first = lambda c: F.min(F.when(F.coalesce(c, F.lit("")) != "", F.struct(seq, c.alias("v")))).getField("v")
    return good.groupBy(t.fold("name").alias("key"), "entity_type").agg(
        F.min(F.struct(seq, F.col("name").alias("v"))).getField("v").alias("name"),
        F.coalesce(first(t.short_text("description")), F.lit("")).alias("description"),
        F.coalesce(first(F.trim("evidence_text")), F.lit("")).alias("evidence_text"),
    )


def valid_relations(relations: DataFrame, seq: str, *within: str) -> DataFrame:
    """Relations (subject, subject_type, relation_type, object, object_type, evidence_text, ...) that pass every rule; the first of each five-part key, or of each key within other columns.

    The schema is a list of its 137 allowed combinations and is asked first, as it costs least.
    """
    rows = relations.withColumns({c: t.shown(c) for c in ("subject", "object")} | {c: F.trim(c) for c in ("subject_type", "object_type", "relation_type", "evidence_text")})
    allowed = rows.filter(F.concat("relation_type", F.lit(" "), "subject_type", F.lit(" "), "object_type").isin([" ".join(x) for x in schema.allowed_ends()]))
    synonym = synonym_valid(F.col("subject"), F.col("subject_type"), F.col("object"), F.col("object_type"), F.col("evidence_text"))
    kept = allowed.filter(~question_only(F.col("evidence_text")) & ~bad_name(F.col("subject")) & ~bad_name(F.col("object")))
    kept = kept.filter((F.col("relation_type") != "DONG_NGHIA_VOI") | synonym).filter((F.col("relation_type") != "CHAN_DOAN_BANG") | (F.col("object_type") == "PHUONG_PHAP_CHAN_DOAN"))
    keyed = kept.withColumns({"subject_key": t.folded("subject"), "object_key": t.folded("object")})
    w = Window.partitionBy(*within, "subject_key", "subject_type", "relation_type", "object_key", "object_type").orderBy(seq)
    return keyed.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def missing_ends(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(key, entity_type): ends of valid relations that no valid entity stands for."""
    ends = relations.select(F.col("subject_key").alias("key"), F.col("subject_type").alias("entity_type")).union(relations.select("object_key", "object_type")).distinct()
    return ends.join(entities.select("key", "entity_type"), ["key", "entity_type"], "left_anti")
