"""Every query with SQL, held against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from glossa import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    a, b = catalog.QUERIES[name](spark, DIR).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert plain(a) == plain(b)
    assert {c: str(a[c].dtype) for c in a} == {c: str(b[c].dtype) for c in b}


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())
