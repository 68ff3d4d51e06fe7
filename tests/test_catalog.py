"""Every query with a stated SQL gives the same rows in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert mine == theirs


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert [r.k for r in rows] == [1, 3, 5, 10]
    assert all(0 <= r.mean_ndcg <= 1 for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
