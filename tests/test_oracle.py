"""Every query with SQL, against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from slotloom.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in os.listdir(DATA)] if os.path.isdir(DATA) else []


def same(spark, query, sql, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    found, expected = query(spark, data), con.sql(sql)
    names = sorted(found.columns)
    assert names == sorted(expected.columns)
    at = [expected.columns.index(c) for c in names]
    assert sorted(repr(tuple(r[c] for c in names)) for r in found.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in expected.fetchall())


@pytest.mark.skipif(not TABLES, reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.skipif(not TABLES, reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
