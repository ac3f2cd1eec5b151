"""Every query that has an SQL text gives the same rows as DuckDB."""

import math
import os
from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from lotwise.scale import scratch_scope

SQL, QUERIES = oracle_sql(), queries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, (int, float)):
        return (1, "nan") if isinstance(value, float) and math.isnan(value) else (1, repr(float(value)))
    return (2, str(value))


def bag(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    with scratch_scope(spark):
        frame = QUERIES[name](spark, sf_dir)
        cursor = duck.execute(SQL[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(frame.columns) == sorted(columns)
        assert bag(frame.columns, [tuple(r) for r in frame.collect()]) == bag(columns, cursor.fetchall())


def test_every_sql_text_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and all(r.q15 <= r.q50 <= r.q85 for r in rows)
