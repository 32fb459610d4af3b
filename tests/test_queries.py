"""Every registered query with SQL against DuckDB at the smallest size."""

import os

import duckdb
import pandas as pd
import pytest

from gridloom.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def norm(d: pd.DataFrame) -> list:
    def one(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
            return ""
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return str(bool(x))
        try:
            return f"{round(float(x), 3) + 0.0:.3f}"
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(one(x) for x in row) for row in d[sorted(d.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
