"""Which put of a log goes to which flush, by the bytes that a write buffer counts.

A new key counts its key and value, an overwrite only the difference of the values; the buffer is flushed, and begins anew,
once its size reaches the threshold. Each boundary depends on all puts before it, yet no task sorts or sees them all: the puts are
dealt into ranges of their order. A buffer that comes into a range with something in it is full no later than one that begins empty
there, so the first boundary in a range is one of its first puts (its head), and every one of these is followed to the last boundary
that it leads to within the range. One ordered stream of heads and of what follows the last boundaries, two buffers' puts a range,
then tells each range's first boundary, and the ranges find the others by themselves. A buffer as large as a range makes all of the
range its head. The rows of the log get their flush by a running count of boundaries over ranges. The store itself needs no such
boundaries: it flushes by whole batches.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators.running import running
from tidemark.session import ship, written

#: Puts of a range, and the order of puts: whole, so that all passes over a range count its puts alike.
RANGE, ORDER = 250_000, ("part", "seq", "k", "vb")
#: What a range tells of itself: puts of its head, where each leads to, puts after the last boundaries.
HEAD, LEADS, TAIL = 0, 1, 2
ENDS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("at", pa.int64()), ("k", pa.binary()), ("kb", pa.int64()), ("vb", pa.int64()), ("last", pa.int64())])


class _Range:
    """The puts of a range in order: how far a buffer reaches that begins empty after each of them."""

    def __init__(self, part: int, threshold: int):
        self.part, self.threshold = part, threshold
        self.window, self.held, self.size = deque(), {}, 0  # the puts after `after`; puts of a key among them and its last size; their bytes
        self.after, self.at = -1, -1
        self.chains = {}  # a boundary whose buffer is not full yet: the puts of the head that lead to it

    def put(self, k, kb: int, vb: int):
        """Takes the next put; its row if it is one of the head."""
        self.at += 1
        head = self.after == -1
        if head:
            self.chains[self.at] = [self.at]
        n, old = self.held.get(k, (0, 0))
        self.held[k] = (n + 1, vb)
        self.size += vb - old if n else kb + vb
        self.window.append((k, kb, vb))
        # full: the buffer that begins after `after` ends here; none that begins later ends before
        while self.size >= self.threshold and self.after < self.at:
            if led := self.chains.pop(self.after, None):
                self.chains.setdefault(self.at, []).extend(led)
            self.after += 1
            old_k, old_kb, _ = self.window.popleft()
            n, last = self.held.pop(old_k)
            if n > 1:
                self.held[old_k] = (n - 1, last)
            else:
                self.size -= old_kb + last
        return (self.part, HEAD, self.at, k, kb, vb, None) if head else None

    def rest(self):
        """Where the head leads to and the puts after that; nothing if no buffer is full within the range, as its head is all of it."""
        if self.after == -1:
            return
        for last, led in self.chains.items():
            yield from ((self.part, LEADS, h, None, None, None, last) for h in led)
        first = min(self.chains)
        yield from ((self.part, TAIL, self.after + 1 + i, *put, None) for i, put in enumerate(self.window) if self.after + 1 + i > first)


def _rows(batches, *names):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _batches(rows, schema: pa.Schema):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _told(rows, threshold: int):
    """Heads, leads and tails of ranges that come one after another."""
    now = None
    for part, k, kb, vb in rows:
        if now is None or now.part != part:
            if now is not None:
                yield from now.rest()
            now = _Range(part, threshold)
        if row := now.put(k, kb, vb):
            yield row
    if now is not None:
        yield from now.rest()


def _firsts(rows, threshold: int):
    """(part, first): the first boundary of each range that has one, from heads, leads and tails in order of ranges."""
    buffer, size, now, first, last = {}, 0, None, None, None
    for part, kind, at, k, kb, vb, lead in rows:
        if part != now:
            now, first, last = part, None, None
        if kind == LEADS:
            if at == first:  # what the head left in the buffer is in the tail again
                buffer, size, last = {}, 0, lead
        elif kind == HEAD or (last is not None and at > last):
            size += vb - buffer[k] if k in buffer else kb + vb
            buffer[k] = vb
            if kind == HEAD and first is None and size >= threshold:
                buffer, size, first = {}, 0, at
                yield part, at


def _ends(rows, threshold: int):
    """The sequence numbers of boundaries of ranges from their first ones on."""
    now, at, buffer, size = None, 0, {}, 0
    for part, first, seq, k, kb, vb in rows:
        now, at = part, at + 1 if part == now else 0
        if at > first:
            size += vb - buffer[k] if k in buffer else kb + vb
            buffer[k] = vb
        if at == first or (at > first and size >= threshold):
            buffer, size = {}, 0
            yield (seq,)


def flush_boundaries(log: DataFrame, threshold: int, payload_bytes: Column, key: str = "key", seq: str = "seq", tombstone: str = "tombstone", ranges: int | None = None) -> DataFrame:
    """log with `flush`: the number of the flush that takes each row, and -1 for rows left in the buffer at the end."""
    ship(log.sparkSession)
    kind = log.schema[key].dataType
    sized = log.select(
        F.col(seq).cast("long").alias("seq"), codec.encode(F.col(key), kind).alias("k"),
        codec.key_size(F.col(key), kind).cast("long").alias("kb"), codec.value_size(F.col(tombstone), payload_bytes).cast("long").alias("vb"),
    )
    n = ranges or -(-log.count() // RANGE) or 1
    puts = written(sized.repartitionByRange(n, "seq").withColumn("part", F.spark_partition_id()), "puts")

    def tell(batches):
        return _batches(_told(_rows(batches, "part", "k", "kb", "vb"), threshold), ENDS)

    def begin(batches):
        return _batches(_firsts(_rows(batches, *ENDS.names), threshold), pa.schema([("part", pa.int32()), ("first", pa.int64())]))

    def end(batches):
        return _batches(_ends(_rows(batches, "part", "first", "seq", "k", "kb", "vb"), threshold), pa.schema([("last", pa.int64())]))

    in_order = lambda df: df.repartition(n, "part").sortWithinPartitions(*ORDER)
    told = in_order(puts).mapInArrow(tell, "part int, kind int, at long, k binary, kb long, vb long, last long")
    firsts = written(told.repartition(1).sortWithinPartitions("part", "kind", "at").mapInArrow(begin, "part int, first long"), "firsts")
    ends = written(in_order(puts.join(firsts, "part")).mapInArrow(end, "last long"), "flushes")
    total = ends.count()
    rows = log.withColumn("__x", F.col(seq).cast("long")).withColumn("__end", F.lit(0).cast("long"))
    marks = ends.select(F.col("last").alias("__x"), F.lit(1).cast("long").alias("__end"))
    counted = running(rows.unionByName(marks, allowMissingColumns=True), ["__x", "__end"], F.col("__end"), F.sum, "__before").where("__end = 0")
    return counted.select(*log.columns, F.when(F.col("__before") < total, F.col("__before")).otherwise(-1).cast("int").alias("flush"))
