"""Queries against the SQL that states them, on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry  # the repository is on the path, see conftest
from wavecohort import jobs

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    return sorted(tuple(repr(r[c]) for c in columns) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(jobs.SQL))
def test_matches_sql(spark, duck, name):
    got = jobs.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(jobs.SQL[name])
    assert columns == sorted(want.columns)
    data = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert rows(columns, [r.asDict() for r in got.collect()]) == rows(columns, data)


def test_entry_has_everything(spark):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and set(jobs.QUERIES) <= set(q)
    assert entry.entry(spark).count() > 0
