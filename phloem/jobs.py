"""Jobs for spark-submit: python -m phloem.jobs NAME --tables DIR --out DIR [options].

evaluate  retrieval metrics of the built-in questions by method: rows as JSON lines, a summary as CSV
ingest    extraction records (JSON lines) of the chunks into entities, relations, mentions, points and counts; chunks that
          an earlier run has finished are skipped
profiles  entity profiles and relation keywords made anew, a page of them or all; --dry-run only counts
backfill  points of the raw text of every live chunk
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phloem.operators import graph, vector
from phloem.plans import evaluate, ingest, profiles
from phloem.queries import retrieval
from phloem.queries.graph import Graph
from phloem.sources import readers, writers
from phloem.storage import Stage, exists, table


def run_evaluate(spark: SparkSession, tables: str, out: str) -> DataFrame:
    rows = Stage(spark, "evaluation").write(retrieval.QUERIES["retrieval_evaluation"](spark, tables))
    summary = evaluate.summary(rows, ["hit_at_1", "hit_at_3", "hit_at_5", "mrr"])
    writers.write_report(rows, summary, out)
    return summary


def pending_records(spark: SparkSession, records: DataFrame, out: str) -> DataFrame:
    """The records of chunks that no earlier run into ``out`` has finished; failed ones are taken again."""
    done = f"{out}/chunk_stats"
    return records.join(spark.read.parquet(done).filter("ok").select("chunk_id"), "chunk_id", "left_anti") if exists(spark, done) else records


def run_ingest(spark: SparkSession, tables: str, out: str, lines: str) -> DataFrame:
    """Append what the pending records give; a reader merges the writes of several runs as ``operators.merge`` does."""
    stage = Stage(spark, "ingest")
    chunks = graph.current_chunks(table(spark, tables, "chunks"))
    records = stage.write(pending_records(spark, readers.extractions(spark, lines).select("chunk_id", "ok", "entities", "relations"), out), "records")
    slim = records.withColumns(
        {
            "entities": F.transform("entities", lambda e: F.struct(*[e[c].alias(c) for c in ("name", "entity_type", "description", "evidence_text")])),
            "relations": F.transform("relations", lambda r: F.struct(*[r[c].alias(c) for c in ("subject", "subject_type", "relation_type", "object", "object_type", "description", "keywords", "evidence_text", "confidence")])),
        }
    )
    written = ingest.write_graph(slim, chunks)
    taken = chunks.join(records.select("chunk_id"), "chunk_id", "left_semi")
    stats = stage.write(written.chunk_stats, "stats")
    for name, df in (("entities", written.entities), ("relations", written.relations), ("mentions", written.mentions), ("points", ingest.vector_points(written, taken)), ("chunk_stats", stats)):
        df.write.mode("append").parquet(f"{out}/{name}")  # the counts come last: a run that broke off before is taken again
    return ingest.article_stats(stats, taken)


def run_profiles(spark: SparkSession, tables: str, out: str, offset: int = 0, limit: int | None = None, dry_run: bool = False) -> DataFrame:
    x = Graph(spark, tables)
    entities = profiles.entity_profiles(x.entities.drop("profile_text")).select("entity_id", "local_keys", "global_keys", "profile_text")
    relations = graph.with_names(x.relations, x.entities).select("relation_id", profiles.relation_keywords().alias("keywords"))
    page = lambda df, key: df if limit is None and not offset else df.orderBy(key).offset(offset).limit(limit if limit is not None else 2**31 - 1 - offset)
    made = {"entities": page(entities, "entity_id"), "relations": page(relations, "relation_id")}
    if not dry_run:
        for name, df in made.items():
            df.write.mode("overwrite").parquet(f"{out}/{name}")
    return made["entities"].agg(F.lit("entities").alias("kind"), F.count("*").alias("n")).union(made["relations"].agg(F.lit("relations"), F.count("*")))


def run_backfill(spark: SparkSession, tables: str, out: str) -> DataFrame:
    points = vector.hold_to(ingest.points("naive", graph.current_chunks(table(spark, tables, "chunks")), "chunk_id", "text"), kind="naive")
    points.write.mode("overwrite").parquet(out)
    return points.groupBy("kind").agg(F.count("*").alias("n"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("job", choices=("evaluate", "ingest", "profiles", "backfill"))
    p.add_argument("--tables", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--records", help="folder of JSON lines, for ingest")
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--limit", type=int)
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.job == "evaluate":
        run_evaluate(spark, a.tables, a.out).show(truncate=False)
    elif a.job == "ingest":
        if not a.records:
            p.error("ingest needs --records")
        run_ingest(spark, a.tables, a.out, a.records).show(truncate=False)
    elif a.job == "profiles":
        run_profiles(spark, a.tables, a.out, a.offset, a.limit, a.dry_run).show(truncate=False)
    else:
        run_backfill(spark, a.tables, a.out).show(truncate=False)


if __name__ == "__main__":
    main()
