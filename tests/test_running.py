"""Running folds, ranks and counts by order against plain Python."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import latest, running


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(200), rng.choice([None, rng.randrange(-50, 50)])) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id int, x int, v int").repartition(7)


@pytest.mark.parametrize("back", [False, True])
@pytest.mark.parametrize("fold", ["sum", "max", "min"])
def test_running(table, fold, back):
    rows, df = table
    got = {r.id: r.run for r in running.running(df, ["x", "id"], F.col("v"), getattr(F, fold), back=back).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]), reverse=back)
    seen = []
    for i, _, v in order:
        seen += [v] if v is not None else []
        assert got[i] == ({"sum": sum, "max": max, "min": min}[fold](seen) if seen else None)


@pytest.mark.parametrize("back", [False, True])
def test_each_row_is_folded_once(table, back):
    """No frame reaches from a row to the end of its range: Spark folds such a frame anew for every row."""
    plan = running.running(table[1], ["x", "id"], F.col("v"), F.min, back=back)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$" in plan and "unboundedfollowing$" not in plan


@pytest.mark.parametrize("back", [False, True])
def test_running_with_nulls_in_the_order(spark, back):
    rows = [(None, 5), (1, 7), (None, 3), (2, 4)]
    got = {r.v: r.run for r in running.running(spark.createDataFrame(rows, "x int, v int"), ["x", "v"], F.col("v"), F.min, back=back).collect()}
    assert got == ({3: 3, 5: 4, 7: 4, 4: 4} if back else {3: 3, 5: 3, 7: 3, 4: 3})


def test_ranked(table):
    rows, df = table
    got = {r.id: r.place for r in running.ranked(df, ["x", "id"]).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda p: p[1])] == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert sorted(got.values()) == list(range(1, 3001))


def test_counts_between_and_holding(spark, table):
    rows, df = table
    rng = random.Random(6)
    ranges = [(i, rng.randrange(-20, 220), rng.randrange(-20, 220)) for i in range(200)]
    asked = spark.createDataFrame(ranges, "range_id int, low int, high int").repartition(3)
    xs = sorted(r[1] for r in rows)
    got = {r.range_id: r.n for r in running.counts_between(df, asked, "x").collect()}
    assert got == {i: bisect.bisect_right(xs, b) - bisect.bisect_left(xs, a) if a <= b else 0 for i, a, b in ranges}
    probes = spark.createDataFrame([(p,) for p in range(-30, 230)], "p int")
    held = {r.p: r.n for r in running.holding(asked, probes, "low", "high", "p").collect()}
    assert held == {p: sum(a <= p <= b for _, a, b in ranges) for p in range(-30, 230)}


def test_neighbours(spark, table):
    rows, df = table
    keys = df.where("x % 3 = 0 and x > 20")
    xs = sorted({r[1] for r in rows if r[1] % 3 == 0 and r[1] > 20})
    probes = spark.createDataFrame([(p,) for p in range(-5, 230)] * 2, "probe int")
    floor = [(r.probe, r.floor) for r in latest.floor_key(keys, probes, "x").collect()]
    above = [(r.probe, r.ceiling) for r in latest.ceiling_key(keys, probes, "x").collect()]
    assert len(floor) == len(above) == 470
    assert all(f == (xs[bisect.bisect_right(xs, p) - 1] if xs[0] <= p else None) for p, f in floor)
    assert all(c == (xs[bisect.bisect_left(xs, p)] if p <= xs[-1] else None) for p, c in above)


def test_shared_tables_are_written_once_and_cleared(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from tidemark import session

    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    df = session.written(spark.range(5), "five")
    assert df.count() == 5 and all(f"{tmp_path}/tidemark/{spark.sparkContext.applicationId}/" in f for f in df.inputFiles())
    session.clear_shared(spark)
    assert not list(Path(tmp_path).rglob("*.parquet"))
