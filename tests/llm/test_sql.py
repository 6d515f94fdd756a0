"""Queries with SQL agree with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from captionlake.llm.entries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        path = f"{SMALL}/{table}.parquet"
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    found = c.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(found.fetchall())
