"""Whole tables against SQL, and what the entry file registers."""

import re

import duckdb
import pytest

import __spark_entry__
from quillspark.llm import registry


@pytest.mark.parametrize("name", [n for n in registry.ORACLES])
def test_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, want = registry.QUERIES[name](spark, sf), c.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = lambda columns, data: sorted(tuple(repr(r[columns.index(x)]) for x in sorted(columns)) for r in data)
    assert rows(df.columns, df.collect()) == rows(list(want.columns), want.fetchall())


def test_registered():
    names = __spark_entry__.queries()
    assert {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == {str(i) for i in range(1, 14)} and "pipeline" in names
