from pyspark.sql import functions as F

import __spark_entry__ as entry
from phloem.operators import extract
from phloem.storage import table


def test_ends_without_an_entity_row(spark):
    entities = spark.createDataFrame([("a", "BENH_LY"), ("b", "TRIEU_CHUNG")], "key string, entity_type string")
    relations = spark.createDataFrame([("a", "BENH_LY", "b", "BENH_LY"), ("a", "BENH_LY", "c", "BENH_LY"), ("c", "BENH_LY", "a", "BENH_LY")], "subject_key string, subject_type string, object_key string, object_type string")
    assert {tuple(r) for r in extract.missing_ends(entities, relations).collect()} == {("b", "BENH_LY"), ("c", "BENH_LY")}


def _rows(spark, sf, name, rows):
    """Rows in the columns of a table; what a row does not name is null."""
    like = table(spark, sf, name).schema
    now = {"ingested_at": "2024-01-01 00:00:00"}
    cols = sorted({k for r in rows for k in r} | {"ingested_at"})
    df = spark.createDataFrame([tuple(str((now | r)[c]) if (now | r).get(c) is not None else None for c in cols) for r in rows], ", ".join(f"`{c}` string" for c in cols))
    return df.select(*[(F.col(f.name) if f.name in cols else F.lit(None)).cast(f.dataType).alias(f.name) for f in like])


def test_an_end_with_few_or_unknown_mentions_is_no_missing_end(spark, sf, tmp_path):
    ents = [("e1", "Viêm da", 5), ("e2", "Chàm", 1), ("e3", "Mề đay", None), ("e4", "Nấm da", 0)]
    _rows(spark, sf, "entities", [{"entity_id": i, "name": n, "entity_type": "BENH_LY", "mention_count": m} for i, n, m in ents]).write.parquet(f"{tmp_path}/entities.parquet")
    rels = [{"relation_id": f"r{i}", "subject_entity_id": "e1", "object_entity_id": i, "relation_type": "LA_DANG_CUA", "evidence_text": "Viêm da có nhiều dạng.", "confidence": 0.9} for i, *_ in ents[1:]]
    _rows(spark, sf, "relations", rels).write.parquet(f"{tmp_path}/relations.parquet")
    for name in ("chunks", "articles"):
        table(spark, sf, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    queries = entry.queries()
    assert queries["valid_relations"](spark, str(tmp_path)).count() == 3
    assert queries["missing_ends"](spark, str(tmp_path)).collect() == []
