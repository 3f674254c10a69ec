"""Every registered query with SQL equals DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from quillspark.plans import checks, graphs, more, stores  # noqa: F401
from quillspark.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf, duck, name):
    df = Q.QUERIES[name](spark, sf)
    got = df.collect()
    if name not in Q.ORACLES:
        assert got
        return
    want = duck.sql(Q.ORACLES[name])
    columns = list(want.columns)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_entry(spark, sf):
    assert os.path.isdir(sf) and __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
