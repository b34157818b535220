import struct

import pytest
from pyspark.sql import types as T

from tidemark.sources import sstable, wal

THREE = [(1, 1, b"hello"), (2, 2, b"world"), (3, 3, None)]


def test_sizes_and_checksum():
    assert [len(wal.frame([r])) for r in THREE] == [42, 42, 33]
    assert int(wal.crc32c([b"123456789"])[0]) == 0xE3069283
    assert wal.crc32c([b"", b"a" * 1000]).tolist()[0] == 0


def damaged(raw: bytes, at: int, new: bytes) -> bytes:
    return raw[:at] + new + raw[at + len(new) :]


CASES = {
    "none": (lambda r: r, wal.CLEAN, 3, 117),
    "cut": (lambda r: r[:100], wal.TRUNCATED, 2, 84),
    "long": (lambda r: damaged(r, 100, struct.pack(">i", 1 << 28)), wal.TRUNCATED, 2, 84),
    "zero length": (lambda r: damaged(r, 100, struct.pack(">i", 0)), wal.LENGTH, 2, 84),
    "zeros": (lambda r: damaged(r, 84, bytes(33)), wal.BAD_MAGIC, 2, 84),
    "flipped": (lambda r: damaged(r, 40, b"\0"), wal.CHECKSUM, 0, 0),
    "short head": (lambda r: r[:90], wal.TRUNCATED, 2, 84),
    "empty": (lambda r: b"", wal.CLEAN, 0, 0),
}


@pytest.mark.parametrize("name", CASES)
def test_replay_stops_where_it_should(name):
    change, reason, n, offset = CASES[name]
    got = wal.replay(change(wal.frame(THREE)))
    assert (got.reason, len(got.records), got.offset) == (reason, n, offset)
    assert got.records == THREE[:n]


def test_stale_tag():
    raw = wal.frame([(1, 30, b"x")]) + wal.frame([(2, 20, b"y")])
    got = wal.replay(raw)
    assert (got.reason, len(got.records), got.offset) == (wal.STALE, 1, 38)


def test_many_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.log").write_bytes(wal.frame([(f"k\0{i}", i, b"v"), ("gone", 10 + i, None)])[: None if i else -1])
    rows = wal.read_wal(spark, str(tmp_path), T.StringType())
    assert sorted((r.key, r.seq, r.tombstone, r.reason) for r in rows.collect()) == [
        ("gone", 11, True, wal.CLEAN), ("gone", 12, True, wal.CLEAN), ("k\0000", 0, False, wal.TRUNCATED), ("k\0001", 1, False, wal.CLEAN), ("k\0002", 2, False, wal.CLEAN),
    ]
    assert wal.recovered(rows).count() == 5


@pytest.mark.parametrize("n,every,indexed", [(10, 3, 4), (23, 5, 5), (1, 5, 1), (100, 10, 10), (0, 5, 0)])
def test_row_segments(spark, tmp_path, n, every, indexed):
    entries = [(i, i + 1, None if i % 7 == 3 else f"v{i}".encode()) for i in range(n)]
    data, index, bloom = sstable.write_bytes(entries, every, level=2)
    assert struct.unpack_from(">i", index)[0] == indexed
    assert len(data) == 16 + sum(13 + (0 if v is None else 4 + len(v)) for *_, v in entries)
    assert sstable.read_bytes(data) == (entries, 2, n)
    assert struct.unpack_from(">iii", bloom)[0] % 2 == 1
    (tmp_path / "dataFile-x").write_bytes(data)
    assert sstable.read_sstables(spark, str(tmp_path)).count() == n


def test_a_log_is_cut_where_replay_stopped(spark, tmp_path):
    log = wal.Log(spark, f"file://{tmp_path}/log")
    log.append([(1, 1, b"hello"), (2, 2, b"world")])
    log.append([(3, 3, None)])
    log.append([(4, 4, b"x"), (5, 5, b"y")])
    log.append([(6, 6, b"z")])
    assert [r[0] for r in log.replay().records] == [1, 2, 3, 4, 5, 6] and log.replay().reason == wal.CLEAN
    third = tmp_path / "log" / log.paths()[2].rsplit("/", 1)[1]
    raw = bytearray(third.read_bytes())
    raw[-1] ^= 1
    third.write_bytes(bytes(raw))
    (tmp_path / "log" / f".{third.name}.crc").unlink(missing_ok=True)
    again = wal.Log(spark, f"file://{tmp_path}/log")
    got = again.recover()
    assert [r[0] for r in got.records] == [1, 2, 3, 4] and got.reason == wal.CHECKSUM
    assert len(again.paths()) == 3 and again.replay().records == got.records and again.replay().reason == wal.CLEAN
    again.append([(7, 7, b"after")])
    assert [r[0] for r in again.replay().records] == [1, 2, 3, 4, 7]
    again.append([(8, 2, b"older seq")])  # the tag stays the running maximum
    assert again.replay().reason == wal.CLEAN and again.replay().tag == 7
    again.reset()
    assert again.replay().records == [] and wal.Log(spark, f"file://{tmp_path}/log").paths() == []


def test_damaged_files_are_cut(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    raw = wal.frame([(1, 1, b"hello"), (2, 2, b"world"), (3, 3, None)])
    for name, data in (("a", raw), ("b", raw[:100]), ("c", raw[:84] + b"\0" * 33), ("d", b"junk" * 10)):
        (tmp_path / "logs" / name).write_bytes(data)
    cut = wal.truncate_logs(spark, f"file://{tmp_path}/logs")
    assert [p.rsplit("/", 1)[1] for p in cut] == ["b", "c", "d"]
    assert [(tmp_path / "logs" / n).read_bytes() for n in "abcd"] == [raw, raw[:84], raw[:84], b""]
    assert wal.truncate_logs(spark, f"file://{tmp_path}/logs") == []
    assert wal.recovered(wal.read_wal(spark, f"file://{tmp_path}/logs")).count() == 7


def test_batches_of_logs_are_bounded_by_bytes(spark):
    assert [b.num_rows for b in wal.some((str(i), bytes(100)) for i in range(10))] == [10]
    assert [b.num_rows for b in wal.some(((str(i), bytes(100)) for i in range(10)), 300)] == [3, 3, 3, 1]
    files = spark.createDataFrame([("a", wal.frame([(1, 1, b"hello")]))], "path string, content binary")
    assert wal.decoded(wal.truncated(files)).count() == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"
