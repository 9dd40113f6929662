"""Every query with SQL gives the SQL's rows."""

import duckdb
import pytest

from corpusweave.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert got
    if sql := catalogue.oracle_sql().get(name):
        r = duck.sql(sql)
        own = r.columns
        assert sorted(own) == cols
        assert got == sorted(repr(tuple(dict(zip(own, x))[c] for c in cols)) for x in r.fetchall())
