"""Each query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from corvane.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(round(float(x), 5) if isinstance(x, float) else (x.item() if hasattr(x, "item") else x) for x in r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_candidates_are_two_steps_deep(spark):
    hops = {r["hop_distance"] for r in catalogue.rank_candidates(spark, SF).select("hop_distance").distinct().collect()}
    assert hops == {0, 1, 2}
