"""Every registered query of the engine against its SQL."""

import duckdb
import pytest

from lexiweave import detail_queries, driver_queries

DATA = "/root/testdata/sf0.001"
QUERIES = driver_queries.queries() | detail_queries.queries()
ORACLES = driver_queries.oracle_sql() | detail_queries.oracle_sql()
TABLES = ["region", "nation", "customer", "supplier", "part", "events", "documents", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
