"""Every query of the catalog against its SQL in DuckDB, on small tables."""

import math
import os

import duckdb
import pytest

from tidemark import queries


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"  # the smallest has too few keys for the ranges


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    found = duck.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert mine == theirs
    assert mine


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, sf):
    plan = queries.scan_range(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(user_id,20)" in plan
    assert "props" not in plan


def test_bloom_rate(spark, sf):
    rows = {r.member: r for r in queries.bloom_fpr(spark, sf).collect()}
    assert rows[True].hits == rows[True]["keys"]
    assert 0.01 <= rows[False].hits / rows[False]["keys"] <= 0.04
