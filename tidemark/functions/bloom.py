"""Bloom filters over encoded keys: two 64-bit FNV-1a hashes, k probes h1 + i * h2 modulo an odd number of bits.

A filter is built from the keys of its segment, dealt by segment: a key is shuffled once, and its segment has one bit set, or up to 16
that are merged if it is large, so neither many segments nor a large one are a burden. Probing runs in Arrow batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.session import ship, written

#: The FNV-1a prime, its offset basis, and the second hash's basis.
PRIME, BASIS, BASIS2 = 0x100000001B3, 0xCBF29CE484222325, 0x84222325CBF29CE4
RATE = 0.02
#: Bits of a filter (some 130,000 keys) beyond which several tasks build it.
SHARE = 1 << 20


@dataclass(frozen=True)
class Shape:
    bits: int
    probes: int

    @staticmethod
    def of(keys: int, rate: float = RATE) -> Shape:
        keys = max(1, keys)
        bits = math.ceil(-keys * math.log(rate) / math.log(2) ** 2) | 1
        return Shape(bits, max(1, round(bits / keys * math.log(2))))


def _hash(raw: list[bytes], basis: int) -> np.ndarray:
    """FNV-1a of many keys at once: byte by byte over all keys that are still that long."""
    size = np.array([len(x) for x in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    begin = np.cumsum(size) - size
    h = np.full(len(raw), basis, np.uint64)
    live = np.flatnonzero(size > 0)
    at = 0
    while len(live):
        h[live] = (h[live] ^ data[begin[live] + at].astype(np.uint64)) * np.uint64(PRIME)
        at += 1
        live = live[size[live] > at]
    return h


def positions(raw: list[bytes], shape: Shape) -> np.ndarray:
    """(keys, probes) bit numbers; hashes are signed 64-bit, the remainder is not negative."""
    one, two = _hash(raw, BASIS).view(np.int64), _hash(raw, BASIS2).view(np.int64)
    with np.errstate(over="ignore"):
        mixed = one[:, None] + np.arange(shape.probes, dtype=np.int64) * two[:, None]
    return np.mod(mixed, np.int64(shape.bits))


def build(raw: list[bytes], shape: Shape) -> bytes:
    bits = np.zeros(shape.bits, bool)
    bits[positions(raw, shape).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def contains(filter_bytes: bytes, raw: list[bytes], shape: Shape) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(filter_bytes, np.uint8), bitorder="little")
    return bits[positions(raw, shape)].all(axis=1) if raw else np.zeros(0, bool)


def _filters(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    groups, raw = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(groups, to_arrow_type(schema["g"].dataType)), pa.array(raw, pa.binary())], ["g", "b"])


def build_filters(rows: DataFrame, group: str, encoded: Column, shape: Shape) -> DataFrame:
    """(group, bloom): one filter of the given shape per value of group.

    The keys of a group come to one task one after another and fill one bit set; a large group is dealt into up to 16 shares, whose bits are merged.
    """
    ship(rows.sparkSession)
    kind = rows.schema[group].dataType
    schema = T.StructType([T.StructField("g", kind), T.StructField("b", T.BinaryType())])

    def partial(batches):
        now, bits = None, None  # the open group, as a tuple, and its bits
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, at = batch.column("g").to_pylist(), positions(batch.column("k").to_pylist(), shape)
            begins = [i for i, g in enumerate(owner) if i == 0 or g != owner[i - 1]]
            done = []
            for i, j in zip(begins, [*begins[1:], len(owner)], strict=True):
                if now != (owner[i],):
                    done += [] if now is None else [(*now, np.packbits(bits, bitorder="little").tobytes())]
                    now, bits = (owner[i],), np.zeros(shape.bits, bool)
                bits[at[i:j].ravel()] = True
                if len(done) * shape.bits > 1 << 25:  # 4 MB of filters
                    yield _filters(done, schema)
                    done = []
            if done:
                yield _filters(done, schema)
        if now is not None:
            yield _filters([(*now, np.packbits(bits, bitorder="little").tobytes())], schema)

    def merge(table: pa.Table) -> pa.Table:
        out = np.zeros(-(-shape.bits // 8), np.uint8)
        for raw in table.column("b").to_pylist():
            out |= np.frombuffer(raw, np.uint8)
        return pa.table({group: table.column("g").slice(0, 1), "bloom": pa.array([out.tobytes()], pa.binary())})

    shares = min(16, 1 + shape.bits // SHARE)
    dealt = rows.select(F.col(group).alias("g"), encoded.alias("k")).withColumn("share", F.pmod(F.hash("k"), F.lit(shares)))
    parts = dealt.repartition("g", "share").sortWithinPartitions("g", "share").select("g", "k").mapInArrow(partial, schema)
    if shares == 1:
        return parts.select(F.col("g").alias(group), F.col("b").alias("bloom"))
    return parts.groupBy("g").applyInArrow(merge, T.StructType([T.StructField(group, kind), T.StructField("bloom", T.BinaryType())]))


def probe(filter_bytes: bytes, shape: Shape):
    """A Pandas UDF on encoded keys that tells which may be in the filter."""

    @F.pandas_udf("boolean")
    def may_contain(keys):
        import pandas as pd

        return pd.Series(contains(filter_bytes, list(keys), shape))

    return may_contain


def definitely_absent(filters: DataFrame, probes: DataFrame, group: str, key: str, shape: Shape) -> DataFrame:
    """(key, group) of the probes (group, key, raw) that their group's filter row (group, bloom, lo, hi) rules out: no bounds, beyond them, or a bit unset.

    Filter and probes of a group meet in one task, where the probes stream by in batches.
    """
    ship(probes.sparkSession)
    schema = T.StructType([probes.schema[key], probes.schema[group]])
    told = written(filters.select(F.col(group).alias("__g"), "bloom", "lo", "hi"), "filters")  # read twice, built once
    asked = probes.join(told, probes[group] == told["__g"])
    # bounds first: what they rule out needs no filter
    beyond = F.col("lo").isNull() | (F.col(key) < F.col("lo")) | (F.col(key) > F.col("hi"))
    near = asked.where(~beyond).select(group, key, "raw")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select([key, group]).slice(0, 0)
        miss = ~contains(right.column("bloom")[0].as_py(), left.column("raw").to_pylist(), shape)
        return left.select([key, group]).filter(pa.array(miss))

    found = near.groupBy(group).cogroup(told.withColumnRenamed("__g", group).select(group, "bloom").groupBy(group)).applyInArrow(run, schema)
    return asked.where(beyond).select(key, group).union(found)
