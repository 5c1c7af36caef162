"""Registered queries against their SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from semspark.plans import fixtures
from semspark.plans import queries as base
from semspark.streaming import queries as _streaming  # noqa: F401

SF = "/root/testdata/sf0.001"


def canon(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.item() if hasattr(v, "item") else v


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(tuple(str(canon(v)) for v in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations events".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def once(spark):
    """The passages and the complete individuals are made once for all queries of this module."""
    kept = {}

    def memo(f):
        def run(session, sf):
            if (f, sf) not in kept:
                kept[f, sf] = f(session, sf)
            return kept[f, sf]

        return run

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fixtures, "passages", memo(fixtures.passages))
        patch.setattr(base, "_people", memo(base._people))
        yield


@pytest.mark.parametrize("name", list(base.QUERIES))
def test_query_equals_sql(spark, db, name):
    got, want = base.QUERIES[name](spark, SF).toPandas(), db.sql(base.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
