"""Driver contract: entry smoke run, registry consistency, oracle agreement
on the small scale factor."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF001
from respscore.plans.catalog import QUERIES
from respscore.sources.tables import TABLES


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 200
    assert df.columns[:8] == ["id", "rank", "method", "url", "status_code", "content_length",
                              "content_type", "location"]


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _canon(cols, rows):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in idx) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle_sf0001(spark, duck, name):
    df = entry.queries()[name](spark, SF001)
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.execute(entry.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert _canon(df.columns, s_rows) == _canon(d_cols, res.fetchall())


def test_entry_schema_is_stable(spark):
    assert entry.entry(spark).schema == entry.entry(spark).schema


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_columns_are_unique(spark, name):
    cols = entry.queries()[name](spark, SF001).columns
    assert len(cols) == len(set(cols))
