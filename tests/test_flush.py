import bisect
import random

from pyspark.sql import functions as F

from tidemark.operators import flush
from tidemark.operators.flush import flush_boundaries


def flushes(spark, rows, threshold):
    df = spark.createDataFrame([(k, i, v is None, v) for i, (k, v) in enumerate(rows)], "key int, seq long, tombstone boolean, value string").repartition(3)
    got = flush_boundaries(df, threshold, F.octet_length("value")).orderBy("seq").collect()
    return [r.flush for r in got]


def test_the_fourth_put_flushes(spark):
    assert flushes(spark, [(k, "x") for k in (1, 2, 3)], 70) == [-1, -1, -1]  # 54 bytes
    assert flushes(spark, [(k, "x") for k in (1, 2, 3, 4, 5)], 70) == [0, 0, 0, 0, -1]  # 72 bytes, then 18


def test_overwrites_count_differences(spark):
    assert flushes(spark, [(1, "x")] * 50, 70) == [-1] * 50
    assert flushes(spark, [(1, "x"), (1, "x" * 60), (2, None)], 70) == [0, 0, -1]
    assert flushes(spark, [], 70) == []


def plain(puts, threshold):
    """Boundaries of (seq, key, key bytes, value bytes) in one walk."""
    ends, buffer, size = [], {}, 0
    for seq, k, kb, vb in puts:
        size += vb - buffer[k] if k in buffer else kb + vb
        buffer[k] = vb
        if size >= threshold:
            ends.append(seq)
            buffer, size = {}, 0
    return ends


def test_ranges_give_the_boundaries_of_one_walk():
    for case in range(300):
        rng = random.Random(case)
        keys, threshold = rng.choice([1, 2, 5, 30, 500]), rng.choice([1, 20, 70, 300, 2000, 10**6])
        puts = [(10 * i, k, 4, rng.choice([9, 14, 21, 60])) for i, k in enumerate(rng.randrange(keys) for _ in range(rng.randrange(1, 400)))]
        cuts = sorted(rng.randrange(len(puts)) for _ in range(rng.randrange(12)))
        part = [bisect.bisect_right(cuts, i) for i in range(len(puts))]
        told = flush._told(((p, k, kb, vb) for p, (_, k, kb, vb) in zip(part, puts, strict=True)), threshold)
        first = dict(flush._firsts(sorted(told, key=lambda r: r[:3]), threshold))
        got = flush._ends(((p, first[p], *put) for p, put in zip(part, puts, strict=True) if p in first), threshold)
        assert [seq for (seq,) in got] == plain(puts, threshold), case


def test_one_task_sees_two_buffers_of_a_range():
    """Of 20 ranges of 1,000 puts, buffers of some 10 puts each."""
    rng = random.Random(1)
    told = list(flush._told(((i // 1000, rng.randrange(500), 4, 21) for i in range(20_000)), 250))
    assert len(told) < 20 * 40


def test_ranges_on_tables(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(60), i, rng.random() < 0.3) for i in range(4000)]
    df = spark.createDataFrame(rows, "key int, seq long, tombstone boolean").repartition(5)
    got = [r.flush for r in flush_boundaries(df, 500, F.lit(8), ranges=9).orderBy("seq").collect()]
    ends = plain([(s, k, 4, 9 if t else 21) for k, s, t in rows], 500)
    at = [bisect.bisect_left(ends, s) for s in range(4000)]
    assert len(ends) > 50 and got == [a if a < len(ends) else -1 for a in at]
