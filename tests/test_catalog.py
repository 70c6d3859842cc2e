"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from foldmill.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 5) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, con, name):
    got = catalog.QUERIES[name](spark, small)
    rows = sorted((str(tuple(plain(v) for v in r)) for r in got.select(*sorted(got.columns)).collect()))
    assert rows
    if name in catalog.SQL:
        want = con.sql(catalog.SQL[name])
        assert sorted(want.columns) == sorted(got.columns)
        at = [want.columns.index(c) for c in sorted(got.columns)]
        assert rows == sorted(str(tuple(plain(r[k]) for k in at)) for r in want.fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["key", "n"] and df.count() == 24743
