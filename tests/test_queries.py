"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from docquarry import catalog

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}{'' if os.path.isfile(f'{SF}/{name}') else '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    found = catalog.flagship(spark, SF).orderBy("rank").collect()
    assert [(r["citation_id"], r["key"], r["rrf"]) for r in found] == [("C1", 0, 0.01602086), ("C2", 17, 0.01129032), ("C3", 225, 0.01111111)]
