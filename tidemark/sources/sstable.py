"""The private row format of a sorted segment: data, sparse index and bloom file, written and read exactly.

The engine itself stores Parquet; this format is for exchange with stores that use it. Readers are DataFrames: the
data files under a path are decoded by one task each.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.functions.bloom import RATE, Shape, build
from tidemark.session import ship
from tidemark.sources.wal import encode_key, encode_value


def write_bytes(entries: list[tuple[object, int, bytes | None]], every: int = 16, level: int = 0) -> tuple[bytes, bytes, bytes]:
    """(key, seq, value or None) in key order to the bytes of the data, index and bloom files."""
    body, index, at = [], [], 16
    for i, (key, seq, value) in enumerate(entries):
        if i % every == 0:
            index.append(encode_key(key) + struct.pack(">q", at))
        body.append(encode_key(key) + encode_value(seq, value))
        at += len(body[-1])
    head = struct.pack(">iiq", len(entries), level, max((s for _, s, _ in entries), default=0))
    shape = Shape.of(len(entries), RATE)
    bits = build([encode_key(k) for k, *_ in entries], shape).rstrip(b"\0") if entries else b""
    return head + b"".join(body), struct.pack(">i", len(index)) + b"".join(index), struct.pack(">iii", shape.bits, shape.probes, len(bits)) + bits


def read_bytes(raw: bytes, strings: bool = False):
    """(entries, level, greatest seq); the header's count governs."""
    count, level, last = struct.unpack_from(">iiq", raw)
    at, out = 16, []
    for _ in range(count):
        if strings:
            end = at
            while raw[end : end + 2] != b"\0\0":
                end += 2 if raw[end : end + 1] == b"\0" else 1
            key: object = raw[at:end].replace(b"\0\xff", b"\0").decode()
            at = end + 2
        else:
            key, at = int.from_bytes(raw[at : at + 4], "big") - (1 << 31), at + 4
        seq, dead = struct.unpack_from(">q?", raw, at)
        at += 9
        value = None
        if not dead:
            (n,) = struct.unpack_from(">i", raw, at)
            value, at = raw[at + 4 : at + 4 + n], at + 4 + n
        out.append((key, seq, value))
    return out, level, last


def decoded(files: DataFrame, key: T.DataType | None = None) -> DataFrame:
    """(file, level, key, seq, tombstone, value) of data files (path, content)."""
    ship(files.sparkSession)
    kind = key or T.IntegerType()
    strings = isinstance(kind, T.StringType)
    schema = pa.schema([("file", pa.string()), ("level", pa.int32()), ("key", pa.string() if strings else pa.int32()), ("seq", pa.int64()), ("tombstone", pa.bool_()), ("value", pa.binary())])

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                entries, level, _ = read_bytes(raw, strings)
                for i in range(0, len(entries), 10_000):
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (name, level, k, s, v is None, v), strict=True)) for k, s, v in entries[i : i + 10_000]], schema)

    return files.select("path", "content").mapInArrow(run, f"file string, level int, key {kind.simpleString()}, seq long, tombstone boolean, value binary")


def read_sstables(spark: SparkSession, path: str, key: T.DataType | None = None) -> DataFrame:
    """decoded() of all data files under path."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", "dataFile-*").load(path), key)
