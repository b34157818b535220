import dataclasses
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import merge
from tidemark.operators.compaction import Full, Leveled
from tidemark.plans.store import LostRows, Store
from tidemark.sources.manifest import CommitConflict, MissingFile

ROW = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("value", T.BinaryType())])


def puts(spark, pairs, start=0):
    rows = [(k, v.encode()) for k, v in pairs]
    return spark.createDataFrame(rows, ROW).coalesce(1)


def keys(spark, ks):
    return spark.createDataFrame([(k,) for k in ks], T.StructType([T.StructField("key", T.IntegerType())])).coalesce(1)


def state(df):
    return [(r.key, bytes(r.value).decode()) for r in df.collect()]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s", T.IntegerType(), selector=Full(2))


def test_scan_with_deletes_and_tail(spark, store):
    store.put_batch(puts(spark, [(i, f"v{i}") for i in range(1, 6)]))
    store.delete_batch(keys(spark, [3]))
    store.flush()
    store.put_batch(puts(spark, [(6, "v6")]))
    assert [k for k, _ in state(store.scan(2, 5))] == [2, 4, 5]
    assert [k for k, _ in state(store.scan(1, 6))] == [1, 2, 4, 5, 6]
    assert state(store.scan(5, 2)) == []
    assert [k for k, _ in state(store.scan(limit=2))] == [1, 2]
    assert store.get(3) is None and store.get(99) is None and store.get(6) == b"v6"
    got = {r.key: r.value for r in store.multi_get(keys(spark, [1, 3, 99])).collect()}
    assert bytes(got[1]) == b"v1" and got[3] is None and got[99] is None


def test_disjoint_segments_need_no_shuffle(spark, store):
    for low in (0, 100):
        store.put_batch(puts(spark, [(low + i, "x") for i in range(10)]))
        store.flush()
    plan = store.snapshot().live()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and store.snapshot().live().count() == 20
    store.put_batch(puts(spark, [(105, "new")]))
    assert "Exchange" in store.snapshot().live()._jdf.queryExecution().executedPlan().toString()
    assert store.get(105) == b"new" and len(state(store.scan(100, 200))) == 10


def test_many_ranges_at_once(spark, store):
    store.put_batch(puts(spark, [(i, f"v{i}") for i in range(50)]))
    store.flush()
    store.delete_batch(keys(spark, [7]))
    ranges = spark.createDataFrame([(1, 5, 9), (2, 45, 99), (3, 9, 5), (4, 60, 70), (5, 0, 49)], "range_id int, low int, high int")
    got = {}
    for r in store.multi_scan(ranges, limit=4).collect():
        got.setdefault(r.range_id, []).append(r.key)
    assert {k: sorted(v) for k, v in got.items()} == {1: [5, 6, 8, 9], 2: [45, 46, 47, 48], 5: [0, 1, 2, 3]}
    assert store.multi_scan(ranges.where("false")).count() == 0


def test_later_row_of_a_batch_wins_and_seq_is_dense(spark, store):
    store.put_batch(puts(spark, [(1, "a"), (1, "b"), (2, "c")]))
    assert state(store.scan()) == [(1, "b"), (2, "c")]
    assert store.manifest.load().last_seq == 3
    assert sorted(r.seq for r in store.snapshot().log().collect()) == [1, 2, 3]


def test_reopen_keeps_the_tail_and_the_counter(spark, store):
    store.put_batch(puts(spark, [(1, "a")]))
    store.close()
    again = Store(spark, store.path)
    assert again.get(1) == b"a"
    again.put_batch(puts(spark, [(1, "b")]))
    assert again.manifest.load().last_seq == 2 and again.get(1) == b"b"
    with pytest.raises(TypeError):
        Store(spark, store.path, T.StringType())


def test_null_values_are_refused(spark, store):
    bad = spark.createDataFrame([(1, None)], ROW)
    with pytest.raises(Exception, match="value exactly if"):
        store.put_batch(bad)
    store.put_batch(puts(spark, [(1, "")]))
    assert store.get(1) == b""


def test_compaction_leaves_the_scan_alone(spark, store):
    for round_ in range(3):
        store.put_batch(puts(spark, [(i, f"{round_}-{i}") for i in range(round_, 20, 2)]))
        store.delete_batch(keys(spark, [round_]))
        store.flush()
    before = state(store.scan())
    assert len(store.manifest.load().segments) >= 3
    store.compact_all()
    v = store.manifest.load()
    assert len(v.segments) == 1 and v.segments[0].tombstones == 0
    assert state(store.scan()) == before
    assert all(store.get(k) == x.encode() for k, x in before)


def test_old_snapshots_stay_readable_until_closed(spark, store):
    store.put_batch(puts(spark, [(1, "a")]))
    store.flush()
    snap = store.snapshot()
    store.put_batch(puts(spark, [(1, "b"), (2, "c")]))
    store.flush()
    store.settle()
    store.vacuum()
    assert state(snap.scan()) == [(1, "a")]
    snap.close()
    snap.close()
    assert store.vacuum()
    assert state(store.scan()) == [(1, "b"), (2, "c")]
    assert store.vacuum() == []


def test_loser_of_overlapping_commits_leaves_nothing(spark, store):
    for i in range(2):
        store.put_batch(puts(spark, [(i, "x")]))
        store.flush()
    picked = list(store.manifest.load().segments)
    other = Store(spark, store.path, selector=Full(2))
    other.compact(picked)
    data = set(store.manifest.files.names(f"{store.path}/data"))
    with pytest.raises(CommitConflict):
        store.compact(picked)
    store.vacuum()
    assert state(store.scan()) == [(0, "x"), (1, "x")]
    assert len(set(store.manifest.files.names(f"{store.path}/data")) - data) == 0


def test_disjoint_commits_both_succeed(spark, store):
    for i in range(4):
        store.put_batch(puts(spark, [(i, "x")]))
        store.flush()
    a, b, c, d = store.manifest.load().segments
    store.compact([a, b])
    Store(spark, store.path, selector=Full(2)).compact([c, d])
    assert len(store.manifest.load().segments) == 2 and len(state(store.scan())) == 4


def test_two_writers_lose_no_batch(spark, store):
    errors = []

    def write(base):
        try:
            s = Store(spark, store.path)
            for i in range(2):
                s.put_batch(puts(spark, [(base + i, "x")]))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(b,)) for b in (0, 100)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    assert [k for k, _ in state(store.scan())] == [0, 1, 100, 101]
    assert sorted(r.seq for r in store.snapshot().log().collect()) == [1, 2, 3, 4]


def test_a_replayed_batch_is_written_once(spark, store):
    store.put_batch(puts(spark, [(1, "a")]), batch_id="b1")
    store.put_batch(puts(spark, [(1, "z")]), batch_id="b1")
    assert store.get(1) == b"a"


def test_missing_file_is_refused(spark, store):
    store.put_batch(puts(spark, [(1, "a")]))
    store.flush()
    store.manifest.files.delete(store.manifest.load().segments[0].path)
    with pytest.raises(MissingFile):
        Store(spark, store.path)


def test_torn_manifest_is_ignored(spark, store):
    store.put_batch(puts(spark, [(1, "a")]))
    store.manifest.files.write(f"{store.path}/manifest/.tmp-torn", '{"number": 99')
    assert Store(spark, store.path).get(1) == b"a"


def test_leveled_keeps_tombstones_that_deeper_levels_need(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/l", T.IntegerType(), selector=Leveled(level0=2, base=1))
    store.put_batch(puts(spark, [(i, "old") for i in range(10)]))
    store.flush()
    store.compact(list(store.manifest.load().segments), level=2)
    for i in range(2):
        store.delete_batch(keys(spark, [5, 50 + i]))
        store.flush()
    store.compact()
    top = [s for s in store.manifest.load().segments if s.level == 1]
    assert sum(s.tombstones for s in top) == 1  # key 5; 50 and 51 lie nowhere else
    assert 5 not in [k for k, _ in state(store.scan())]


LOG = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("tombstone", T.BooleanType()), T.StructField("value", T.StringType())])


def test_merge_cases(spark):
    log = lambda *rows: spark.createDataFrame([(k, s, v is None, v) for k, s, v in rows], LOG)
    get = lambda df: sorted((r.key, r.seq, r.value) for r in df.collect())
    assert get(merge.merge_drop_all(log((2, 9, None), (2, 3, "V")))) == []
    assert get(merge.merge_drop_all(log((2, 3, None), (2, 9, "V")))) == [(2, 9, "V")]
    assert get(merge.merge_drop_all(log((1, 1, None), (2, 2, None), (3, 3, None), (4, 4, "V")))) == [(4, 4, "V")]
    below = log((1, 1, "V"))
    assert get(merge.merge_retain(log((1, 3, None), (2, 2, "V")), below)) == [(1, 3, None), (2, 2, "V")]
    assert get(merge.merge_retain(log((5, 3, None), (2, 2, "V")), below)) == [(2, 2, "V")]


@pytest.mark.parametrize("held", [0, 7])
def test_cuts_reset_at_each_file(held):
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 400):
        sizes = rng.integers(1, 40, n)
        want, file, size = [], 0, held
        for x in sizes.tolist():
            want.append(file)
            size += x
            if size >= 100:
                file, size = file + 1, 0
        got, number, left = merge.cuts(sizes, held, 100)
        assert got.tolist() == want and (number, left) == (file, size)


def test_splits(spark):
    rows = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 37 + 1).alias("size"), F.lit("x" * 50).alias("value"))
    files, size = [[]], 0
    for k in range(1000):
        files[-1].append(k)
        size += k % 37 + 1
        if size >= 250:
            files, size = [*files, []], 0
    exact = {(r.key, r.file) for r in merge.exact_split(rows.repartition(5), "size", 250).collect()}
    assert exact == {(k, i) for i, f in enumerate(files) for k in f}
    split = merge.level_split(rows.repartition(5), "size", 250, ranges=3).collect()
    assert sorted(r.key for r in split) == list(range(1000))
    by = {}
    for r in split:
        by.setdefault((r.part, r.file), []).append(r)
    spans = sorted((min(r.key for r in f), max(r.key for r in f), sum(r.size for r in f), part) for (part, _), f in by.items())
    assert all(a[1] < b[0] for a, b in zip(spans[:-1], spans[1:]))
    assert all(250 <= s[2] < 290 for s, after in zip(spans[:-1], spans[1:]) if s[3] == after[3])


def test_no_row_is_lost_by_writes_of_many_files(spark, tmp_path):
    """Default adaptive execution, many shuffle partitions, wide values: every key stays, files are disjoint and near their size."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        n = 200_000
        rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("key"), F.rpad(F.col("id").cast("string"), 128, "x").cast("binary").alias("value"))
        store = Store(spark, f"file://{tmp_path}/big", T.LongType(), selector=Leveled(level0=1, base=1 << 30), file_bytes=500_000, tail_bytes=1 << 40)
        store.put_batch(rows)
        for step in (store.flush, store.compact_all, store.settle):
            v = step()
            assert sum(s.entries for s in v.segments) == n and store.scan().count() == n
            spans = sorted((s.min_key, s.max_key) for s in v.segments)
            assert len(spans) > 40 and all(a[1] < b[0] for a, b in zip(spans[:-1], spans[1:]))
            assert all(s.bytes <= 500_000 + 300 for s in v.segments) and sum(s.bytes >= 500_000 for s in v.segments) >= 0.7 * len(spans)
        assert store.snapshot().log().select("key").distinct().count() == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_write_that_loses_rows_is_not_committed(spark, store, monkeypatch):
    store.put_batch(puts(spark, [(i, "x") for i in range(10)]))
    told = store._described
    monkeypatch.setattr(store, "_described", lambda *a, **b: [dataclasses.replace(s, entries=s.entries - 1) for s in told(*a, **b)])
    with pytest.raises(LostRows):
        store.flush()
    monkeypatch.undo()
    assert len(state(store.scan())) == 10 and not store.manifest.load().segments
    assert store.manifest.files.names(f"{store.path}/data") == []


def test_batch_numbers_are_bounded(spark, store):
    for i in range(3):
        store.put_batch(puts(spark, [(i, "a")]), batch_id=f"s-{i}")
        store.put_batch(puts(spark, [(i, "z")]), batch_id=f"s-{i}")
    store.put_batch(puts(spark, [(9, "late")]), batch_id="s-1")
    assert store.manifest.load().batches == {"s": 2}
    assert state(store.scan()) == [(0, "a"), (1, "a"), (2, "a")]
