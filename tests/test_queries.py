"""Every query with SQL against DuckDB, at the smallest scale; the streamed edge table."""

import duckdb
import pytest

import __spark_entry__
from lattica import queries

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    want = duck.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    expected = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in want.fetchall())
    assert got == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 190
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
