"""Side-by-side check of queries and their SQL: python tests/compare.py SF_DIR NAME..."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def canonical(value):
    if value is None or isinstance(value, (bool, str, bytes)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(x) for x in value)
    if isinstance(value, dict):
        return tuple((k, canonical(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return tuple((k, canonical(v)) for k, v in value.asDict().items())
    return float(value) if type(value).__name__ == "Decimal" else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(df.columns)} and {sorted(names)}", len(got)
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"{len(got)} and {len(want)} rows; only ours {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}", len(got)
    return "", len(got)


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in [q for q in queries if not names or any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]:
        t = time.time()
        try:
            if name in sql:
                why, n = compare(spark, con, sf_dir, queries[name], sql[name])
            else:
                why, n = "", queries[name](spark, sf_dir).count()
        except Exception as e:  # noqa: BLE001
            why, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += bool(why)
        print(f"{'FAIL' if why else 'ok  '} {name} {n} rows {time.time() - t:.1f} s{'' if name in sql else ' (no SQL)'} {why}", flush=True)
    print(f"{bad} failed")
