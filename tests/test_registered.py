"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registered

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registered.zone_queries(), registered.zone_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    got = Counter(tuple(r) for r in df.select(columns).collect())
    assert got == Counter(tuple(r[i] for i in order) for r in want.fetchall())
    assert got
    text = df._jdf.queryExecution().executedPlan().toString()
    for slow in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert slow not in text


def test_entry(spark):
    assert registered.entry(spark).count() == 150
