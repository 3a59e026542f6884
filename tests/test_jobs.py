from phloem import jobs
from phloem.queries.building import replay
from phloem.sources import writers


def test_ingest_job_resumes(spark, sf, tmp_path):
    records, _ = replay(spark, sf)
    lines, out = str(tmp_path / "lines"), str(tmp_path / "out")
    writers.append_json(records.filter("chunk_id < 'chunk_8'"), lines)
    first = jobs.run_ingest(spark, sf, out, lines).agg({"chunks": "sum"}).first()[0]
    writers.append_json(records.filter("chunk_id >= 'chunk_8'"), lines)
    second = jobs.run_ingest(spark, sf, out, lines).agg({"chunks": "sum"}).first()[0]
    failed = records.filter("not ok and chunk_id < 'chunk_8'").count()
    assert first + second - failed == records.count()
    assert jobs.pending_records(spark, records, out).filter("ok").count() == 0
    assert spark.read.parquet(f"{out}/entities").count() > 0 and spark.read.parquet(f"{out}/points").filter("kind = 'relation'").count() > 0


def test_profile_and_backfill_jobs(spark, sf, tmp_path):
    out = str(tmp_path / "p")
    counted = {r.kind: r.n for r in jobs.run_profiles(spark, sf, out, dry_run=True).collect()}
    assert not (tmp_path / "p").exists() and counted["entities"] > 100
    paged = {r.kind: r.n for r in jobs.run_profiles(spark, sf, out, offset=counted["entities"] - 5, limit=50).collect()}
    assert paged["entities"] == 5 and spark.read.parquet(f"{out}/entities").count() == 5
    made = jobs.run_backfill(spark, sf, str(tmp_path / "b")).first()
    assert made.n == spark.read.parquet(str(tmp_path / "b")).select("point_id").distinct().count()


def test_a_collection_is_held_to_its_kind(spark):
    import pytest

    from phloem.operators import vector

    rows = spark.createDataFrame([("a", "naive"), ("b", None)], "point_id string, kind string")
    assert vector.hold_to(rows.filter("point_id = 'a'"), kind="naive").count() == 1 and vector.hold_to(rows.limit(0), kind="x").count() == 0
    with pytest.raises(ValueError):
        vector.hold_to(rows, kind="naive")
