import datetime as dt

from phloem.operators.references import orphan_report, reference_status
from pyspark.sql import functions as F

D = dt.datetime


def _parents(spark):
    return spark.createDataFrame([("a", "x", None), ("b", None, None), (None, "y", None)], "k1 string, k2 string, other string")


def _kinds(df):
    return {r["id"]: r["orphan_kind"] for r in df.collect()}


def test_match_semantics_by_null_mask(spark):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", "z"), (3, "a", None), (4, "q", None), (5, None, "x"), (6, None, None), (7, None, "q")], "id int, k1 string, k2 string")
    keys = [("k1", "k1"), ("k2", "k2")]
    assert _kinds(reference_status(refs, _parents(spark), keys, "simple")) == {2: "missing"}
    assert _kinds(reference_status(refs, _parents(spark), keys, "partial")) == {2: "missing", 4: "missing", 7: "missing"}
    assert _kinds(reference_status(refs, _parents(spark), keys, "full")) == {2: "missing", 3: "partial_null", 4: "partial_null", 5: "partial_null", 7: "partial_null"}


def test_kinds_times_blanks_and_repeats(spark):
    parent = spark.createDataFrame(
        [("p1", D(2024, 1, 1), None), ("p2", D(2024, 1, 1), D(2024, 2, 1)), ("p3", D(2024, 1, 1), D(2024, 2, 1)), ("p3", D(2024, 5, 1), None), ("p4", D(2024, 6, 1), None)], "id string, ingested_at timestamp, deleted_at timestamp"
    )
    rows = [("c1", "p1"), ("c2", "p2"), ("c3", " p3 "), ("c4", "p4"), ("c5", "nope"), ("c5", "nope"), ("c6", " "), ("c7", None)]
    child = spark.createDataFrame([(a, b, D(2024, 3, 1), "x") for a, b in rows], "cid string, ref string, at timestamp, orphan_kind string")
    found = orphan_report(child, "child", "cid", "ref", F.col("ref"), "at", parent, "id", "deleted_at", "ingested_at")
    got = {(r.record_key, r.ref_key, r.orphan_kind, r.period_month) for r in found.collect()}
    assert got == {("c2", "p2", "deleted", "2024-03"), ("c4", "p4", "late", "2024-03"), ("c5", "nope", "missing", "2024-03")}
    assert found.count() == 3
    assert orphan_report(child.limit(0), "child", "cid", "ref", F.col("ref"), "at", parent, "id", "deleted_at", "ingested_at").count() == 0
    none = orphan_report(child, "child", "cid", "ref", F.col("ref"), "at", parent.limit(0), "id", "deleted_at", "ingested_at")
    assert {r.orphan_kind for r in none.collect()} == {"missing"}


def test_null_time_is_never_late(spark):
    parent = spark.createDataFrame([("p", D(2024, 6, 1), None)], "id string, ingested_at timestamp, deleted_at timestamp")
    child = spark.createDataFrame([("c", "p", None), ("d", "q", None)], "cid string, ref string, at timestamp")
    got = orphan_report(child, "t", "cid", "ref", F.col("ref"), "at", parent, "id", "deleted_at", "ingested_at").collect()
    assert [(r.record_key, r.orphan_kind, r.period_month) for r in got] == [("d", "missing", None)]
