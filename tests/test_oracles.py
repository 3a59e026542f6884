"""Every query with SQL against it on the smallest tables, core and optional parts alike."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("p") or n.startswith("p5") or not n[1].isdigit()))
def test_sql(spark, sf, name):
    why, _ = compare(spark, duck(sf), sf, QUERIES[name], SQL[name])
    assert not why, why


def test_entry(spark):
    assert entry.entry(spark).count() > 0
