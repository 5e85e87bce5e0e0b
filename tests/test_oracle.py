"""Every engine query that has SQL, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from chiweave.plans.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    cell = lambda v: None if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
