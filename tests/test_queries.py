"""Every registered query with SQL is held against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from aggrolens.plans import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(d: pd.DataFrame) -> list:
    cell = lambda x: None if x is None or x is pd.NA or x != x else str(x) if isinstance(x, str) else round(float(x), 6)
    return sorted((tuple(cell(x) for x in r) for r in d[sorted(d.columns)].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, db, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
