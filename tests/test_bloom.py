import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import bloom, codec


@pytest.mark.parametrize("share", [1 << 20, 100])
def test_filters_of_many_groups(spark, monkeypatch, share):
    monkeypatch.setattr(bloom, "SHARE", share)
    rng, shape = random.Random(2), bloom.Shape.of(60)
    rows = [(rng.choice([None, *range(300)]), rng.randrange(10**6)) for _ in range(9000)]
    df = spark.createDataFrame(rows, "g int, k long").repartition(5)
    found = bloom.build_filters(df, "g", codec.encode_long(F.col("k")), shape)
    own = {}
    for g, k in rows:
        own.setdefault(g, []).append((k + (1 << 63)).to_bytes(8, "big"))
    assert {r.g: bytes(r.bloom) for r in found.collect()} == {g: bloom.build(raw, shape) for g, raw in own.items()}


def test_a_small_segment_has_one_row_of_bits(spark):
    """No partial bit sets of every batch and segment that then are merged."""
    df = spark.range(1000).select((F.col("id") % 50).alias("g"), F.col("id").alias("k"))
    plan = bloom.build_filters(df, "g", codec.encode_long(F.col("k")), bloom.Shape.of(20))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan
