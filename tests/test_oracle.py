"""Every core query that has SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from sitelens.plans import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(x):
    if isinstance(x, (np.ndarray, list, tuple)):
        return tuple(map(plain, x))
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    return round(float(x), 9) if isinstance(x, (int, float, np.integer, np.floating)) else str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df):
    return Counter(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, expected = catalogue.queries()[name](spark, FOLDER).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


#: Queries that SQL can not express, and the test that compares each with brute force.
ELSEWHERE = {"crawl_levels": "test_sources.py", "p1_found": "test_nested.py", "p1_recommendations": "test_nested.py", "p1_hops": "test_nested.py", "p1_plans": "test_nested.py"}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert name in ELSEWHERE
    rows = catalogue.queries()[name](spark, FOLDER)
    assert rows.count() > 0 and rows.dropDuplicates().count() == rows.count()


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
