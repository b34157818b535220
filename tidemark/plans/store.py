"""A versioned key-value store over Parquet segments: batched writes, snapshot reads, flush, compaction, vacuum.

A batch is the unit of durability: put_batch() writes its rows as Parquet once, with numbers of their own, and commits the manifest, which
says where in the sequence they begin. Un-flushed batches form the tail; flush() writes the latest version per key of the tail as level-0 segments, tombstones included.
Reads bind to one manifest version, skip segments by key range (and, for single keys, by bloom filter), and
merge what is left by greatest seq.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
import threading
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.functions import bloom, codec
from tidemark.operators import latest as reads
from tidemark.operators.compaction import Leveled, Selector, SizeTiered
from tidemark.operators.merge import level_split
from tidemark.schema import checked, record_schema
from tidemark.session import ship
from tidemark.sources.manifest import CommitConflict, Manifest, Segment, Version


#: Files a key range of a write is meant to hold: one file a range falls short of the target.
FILES_A_RANGE = 4


class LostRows(Exception):
    """A write holds fewer or more rows than went into it; nothing was committed."""


class Snapshot:
    """One manifest version; holds a pin until closed, which vacuum() respects."""

    def __init__(self, store: Store, version: Version):
        self.store, self.version, self.opened = store, version, time.time()
        store._pins[id(self)] = self

    def close(self) -> None:
        """Releases the pin; closing again does nothing."""
        self.store._pins.pop(id(self), None)

    __enter__ = lambda self: self

    def __exit__(self, *_):
        self.close()

    def _rows(self, parts: Iterable[Segment]) -> DataFrame:
        return self.store._read(list(parts))

    def log(self, low=None, high=None) -> DataFrame:
        """All stored versions of keys between the bounds."""
        v = self.version
        rows = self._rows(s for s in (*v.segments, *v.tail) if s.overlaps(low, high))
        return reads.between(rows, low, high)

    def live(self, low=None, high=None) -> DataFrame:
        """Live rows between the bounds. Segments hold a key once, so those whose key range no other part touches need no merge
        and no shuffle; only parts that overlap are merged."""
        v = self.version
        alone, mixed = _apart([s for s in v.segments if s.overlaps(low, high)], [s for s in v.tail if s.overlaps(low, high)])
        merged = reads.live(reads.between(self._rows(mixed), low, high))
        if not alone:
            return merged
        plain = reads.between(self._rows(alone), low, high).where("not tombstone")
        return plain.unionByName(merged) if mixed else plain

    def scan(self, low=None, high=None, limit: int | None = None) -> DataFrame:
        """(key, value) in key order, bounds inclusive."""
        rows = self.live(low, high).select("key", "value").orderBy("key")
        return rows if limit is None else rows.limit(limit)

    def multi_scan(self, ranges: DataFrame, limit: int | None = None, most: int = 1_000_000) -> DataFrame:
        """(range_id, key, value) of many ranges (range_id, low, high) at once, bounds inclusive, the first `limit` keys of each.

        The live rows are read once; each task sorts its batch and cuts every range out of it by binary search. Ranges are
        broadcast in blocks of `most`.
        """
        ship(self.store.spark)
        rows = self.live().select("key", "value")
        kind = self.store.key_type
        schema = T.StructType([ranges.schema["range_id"], T.StructField("key", kind), T.StructField("value", T.BinaryType())])
        asked = ranges.select("range_id", "low", "high").where("low <= high")
        found, block = None, []

        def of(block: list) -> DataFrame:
            asked = sorted(((r.low, r.high, r.range_id) for r in block), key=lambda r: r[0])
            reach = list(itertools.accumulate((r[1] for r in asked), max))  # the greatest high up to each range
            shared = self.store.spark.sparkContext.broadcast((asked, reach))
            return rows.mapInArrow(_cut(shared, limit, to_arrow_type(ranges.schema["range_id"].dataType)), schema)

        for r in asked.toLocalIterator():
            block.append(r)
            if len(block) == most:
                found, block = (of(block) if found is None else found.union(of(block))), []
        if block or found is None:
            found = of(block) if found is None else found.union(of(block))
        if limit is not None:
            first = Window.partitionBy("range_id").orderBy("key")
            found = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit).drop("n")
        return found

    def get_row(self, key) -> DataFrame:
        """The latest version of one key, a tombstone too."""
        return reads.latest(self._rows(self.candidates(key)).where(F.col("key") == F.lit(key)))

    def get(self, key) -> bytes | None:
        row = self.get_row(key).where("not tombstone").first()
        return bytes(row.value) if row else None

    def candidates(self, key) -> list[Segment]:
        """The parts that may hold a key: by range, and level segments by bloom filter."""
        return [s for s in (*self.version.segments, *self.version.tail) if s.overlaps(key, key) and self.store._may_contain(s, key)]

    def multi_get(self, probes: DataFrame) -> DataFrame:
        """(key, value) for each probed key, value null where absent or deleted."""
        return probes.select("key").join(self.live().select("key", "value"), "key", "left").select("key", "value")


class Store:
    """open: Store(spark, path). Parameters take effect for this handle's writes."""

    def __init__(self, spark: SparkSession, path: str, key: T.DataType | None = None, selector: Selector | None = None, tail_bytes: int = 64 << 20, tail_parts: int = 64,
                 file_bytes: int = 128 << 20, bloom_rate: float = bloom.RATE, background: bool = False):
        # the tail is flushed at tail_bytes or tail_parts batches, whichever comes first
        self.spark, self.path, self.selector = spark, path.rstrip("/"), selector or SizeTiered()
        self.tail_bytes, self.tail_parts, self.file_bytes, self.bloom_rate, self.background = tail_bytes, tail_parts, file_bytes, bloom_rate, background
        self.manifest = Manifest(spark, self.path)
        self._pins: dict[int, Snapshot] = {}
        self._blooms: dict[str, bytes] = {}
        self._worker: threading.Thread | None = None
        self._failure: Exception | None = None
        found = self.manifest.checked()
        if found is None:
            kind = key or T.LongType()
            found = self.manifest.commit(lambda v: dataclasses.replace(v, key=kind.simpleString()))
        self.key_type = T._parse_datatype_string(found.key)
        if key is not None and key != self.key_type:
            raise TypeError(f"the store's keys are {found.key}, not {key.simpleString()}")
        self.schema = record_schema(self.key_type)
        if isinstance(self.selector, Leveled):
            self.selector.pointers = {int(k): v for k, v in found.pointers.items()}

    def close(self) -> None:
        """Waits for a background compaction. The tail stays a tail: it is read again on opening."""
        self.await_compaction()

    # reads

    def snapshot(self, number: int | None = None) -> Snapshot:
        return Snapshot(self, self.manifest.load(number))

    def scan(self, low=None, high=None, limit: int | None = None) -> DataFrame:
        return self._once().scan(low, high, limit)

    def get(self, key) -> bytes | None:
        return self._once().get(key)

    def multi_get(self, probes: DataFrame) -> DataFrame:
        return self._once().multi_get(probes)

    def multi_scan(self, ranges: DataFrame, limit: int | None = None) -> DataFrame:
        return self._once().multi_scan(ranges, limit)

    def as_of(self, seq: int) -> DataFrame:
        """Live rows as they were at seq. Exact as far back as no flush or compaction has merged versions away."""
        return reads.live(reads.as_of(self._once().log(), seq)).select("key", "value")

    def _once(self) -> Snapshot:
        s = self.snapshot()
        s.close()
        return s

    # writes

    def put_batch(self, rows: DataFrame, batch_id: str | None = None) -> Version:
        """rows: (key, value[, order]); later rows win by `order`, or as they come.

        batch_id, "stream-number": numbers of a stream rise, and a batch whose number isn't above the stream's last is ignored as a replay;
        the manifest keeps one number a stream. An id without a number is a stream of one batch.
        """
        return self._append(rows.select("key", F.lit(False).alias("tombstone"), "value", *(["order"] if "order" in rows.columns else [])), batch_id)

    def delete_batch(self, keys: DataFrame, batch_id: str | None = None) -> Version:
        return self._append(keys.select("key", F.lit(True).alias("tombstone"), F.lit(None).cast("binary").alias("value")), batch_id)

    def apply_batch(self, rows: DataFrame, batch_id: str | None = None) -> Version:
        """rows: (key, tombstone, value[, order]): puts and deletes together."""
        return self._append(rows, batch_id)

    def _append(self, rows: DataFrame, batch_id: str | None) -> Version:
        now = self.manifest.load()
        if _replayed(now, batch_id):
            return now
        stream, number = _stream(batch_id)
        rows = checked(rows.withColumn("key", F.col("key").cast(self.key_type)).withColumn("value", F.col("value").cast("binary")))
        if "order" in rows.columns:
            rows = rows.repartitionByRange("order").sortWithinPartitions("order")
        # rows get numbers within their partitions; the partitions' counts, in the manifest, give each its place in the sequence
        path = f"{self.path}/tail/{uuid.uuid4().hex}"
        rows.select("key", "tombstone", "value", F.monotonically_increasing_id().alias("n")).write.parquet(path)
        told = self._staged(path).groupBy(F.shiftright("n", 33).alias("p")).agg(*self._told()).orderBy("p").collect()  # a row per partition
        if not told:
            self.manifest.files.delete(path)
            return now
        total, offsets = 0, [0] * (told[-1].p + 1)
        for r in told:
            offsets[r.p] = total
            total += r.n
        part = Segment(path, -1, total, sum(r.t for r in told), min(r.lo for r in told), max(r.hi for r in told), 0, sum(r.b for r in told) + codec.FILE_HEAD, offsets=tuple(offsets))

        def change(v: Version) -> Version:
            if _replayed(v, batch_id):
                raise CommitConflict("the batch is there already")
            numbered = dataclasses.replace(part, base=v.last_seq, max_seq=v.last_seq + total)
            return dataclasses.replace(
                v, tail=(*v.tail, numbered), last_seq=numbered.max_seq, put_bytes=v.put_bytes + part.bytes, written_bytes=v.written_bytes + part.bytes,
                batches=v.batches | ({stream: number} if batch_id is not None else {}),
            )

        try:
            done = self.manifest.commit(change)  # of two writers the later one's rows follow: nothing is written anew
        except CommitConflict:
            self.manifest.files.delete(path)
            now = self.manifest.load()
            if _replayed(now, batch_id):
                return now
            raise
        if sum(s.bytes for s in done.tail) >= self.tail_bytes or len(done.tail) >= self.tail_parts:
            done = self.flush()
        return done

    def _staged(self, path: str) -> DataFrame:
        return self.spark.read.schema(T.StructType([*(f for f in self.schema if f.name != "seq"), T.StructField("n", T.LongType())])).parquet(path)

    def _read(self, parts: list[Segment]) -> DataFrame:
        """All rows of segments and of batches in the tail, the latter with their sequence numbers."""
        found = []
        if plain := [s.path for s in parts if s.level >= 0]:
            found.append(self.spark.read.schema(self.schema).parquet(*plain))
        for s in parts:
            if s.level < 0:
                before = F.get(F.expr(f"array({', '.join(f'{o}L' for o in s.offsets)})"), F.shiftright("n", 33).cast("int"))
                seq = (before + F.col("n").bitwiseAND((1 << 33) - 1) + F.lit(s.base + 1)).alias("seq")
                found.append(self._staged(s.path).select("key", seq, "tombstone", "value"))
        return functools.reduce(DataFrame.union, found) if found else self.spark.createDataFrame([], self.schema)

    def _told(self) -> list:
        """What a manifest tells of rows, as aggregates."""
        size = codec.record_size(F.col("key"), self.key_type, F.col("tombstone"), F.coalesce(F.octet_length("value"), F.lit(0)))
        return [F.count("*").alias("n"), F.sum(F.col("tombstone").cast("int")).alias("t"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum(size).alias("b")]

    def _described(self, path: str, level: int) -> list[Segment]:
        """The manifest's rows of the files under path, by one aggregate over them."""
        rows = self.spark.read.schema(self.schema).parquet(path).withColumn("file", F.input_file_name())
        told = rows.groupBy("file").agg(*self._told(), F.max("seq").alias("s")).orderBy("lo").collect()  # a row per file
        return [Segment(r.file, level, r.n, r.t, r.lo, r.hi, r.s, r.b + codec.FILE_HEAD) for r in told]

    def _write_segments(self, rows: DataFrame, level: int, inputs: Iterable[Segment]) -> list[Segment]:
        """Key-ordered Parquet files of about file_bytes, each a segment, and their bloom filters; LostRows unless every row is there.

        inputs: the parts that rows come from; their bytes tell how many key ranges, of a few files each, the work is dealt into.
        """
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        size = codec.record_size(F.col("key"), self.key_type, F.col("tombstone"), F.coalesce(F.octet_length("value"), F.lit(0)))
        ranges = max(1, -(-sum(s.bytes for s in inputs) // (FILES_A_RANGE * self.file_bytes)))
        seen = Observation()
        cut = level_split(rows.withColumn("__size", size), "__size", self.file_bytes, ranges=ranges, seen=seen).drop("__size")
        cut.sortWithinPartitions("part", "file", "key").write.partitionBy("part", "file").parquet(path)
        segments = self._described(path, level)
        if sum(s.entries for s in segments) != seen.get.get("n", 0):
            self.manifest.files.delete(path)
            raise LostRows(f"{seen.get.get('n', 0)} rows were to be written, {sum(s.entries for s in segments)} are there")
        if not segments:
            self.manifest.files.delete(path)
            return []
        most = max(s.entries for s in segments)
        filters = f"{path}-bloom"
        stored = self.spark.read.schema(self.schema).parquet(path).withColumn("file", F.input_file_name())
        bloom.build_filters(stored, "file", codec.encode(F.col("key"), self.key_type), bloom.Shape.of(most, self.bloom_rate)).write.parquet(filters)
        return [dataclasses.replace(s, bloom=filters, bloom_keys=most) for s in segments]

    def _may_contain(self, s: Segment, key) -> bool:
        if not s.bloom:
            return True
        if s.path not in self._blooms:
            row = self.spark.read.parquet(s.bloom).where(F.col("file") == s.path).first()
            self._blooms[s.path] = bytes(row.bloom) if row else b""
        raw = self._blooms[s.path]
        return not raw or bool(bloom.contains(raw, [_encoded(key, self.key_type)], bloom.Shape.of(s.bloom_keys, self.bloom_rate))[0])

    def flush(self) -> Version:
        """The tail's latest version per key, tombstones too, as level-0 segments. Nothing to do without a tail."""
        now = self.manifest.load()
        if not now.tail:
            return now
        new = self._write_segments(reads.latest(self._read(list(now.tail))), 0, now.tail)
        done = self._install(now.tail, new, "tail")
        if self.background:
            self.compact_async()
        return done

    def _install(self, old: Iterable[Segment], new: list[Segment], where: str, pointers: dict | None = None) -> Version:
        """Replaces old parts by new ones if all old ones are still there; otherwise the new files go again."""
        gone = {s.path for s in old}

        def change(v: Version) -> Version:
            if not gone <= {s.path for s in getattr(v, where)}:
                raise CommitConflict("a part was replaced meanwhile")
            left = tuple(s for s in getattr(v, where) if s.path not in gone)
            segments = (*(left if where == "segments" else v.segments), *new)
            return dataclasses.replace(
                v, segments=segments, tail=left if where == "tail" else v.tail, written_bytes=v.written_bytes + sum(s.bytes for s in new), pointers=pointers if pointers is not None else v.pointers
            )

        try:
            return self.manifest.commit(change)
        except CommitConflict:
            for p in {s.bloom.removesuffix("-bloom") for s in new} | {s.bloom for s in new}:
                self.manifest.files.delete(p)
            raise

    # compaction

    def compact(self, selected: list[Segment] | None = None, level: int | None = None) -> Version:
        """Merges what the selector picks (or `selected`), one round. Tombstones stay where an older segment may hold the key."""
        now = self.manifest.load()
        picked = self.selector.select(list(now.segments)) if selected is None else selected
        if not picked:
            return now
        leveled = isinstance(self.selector, Leveled)
        target = level if level is not None else (min(s.level for s in picked) + 1 if leveled else 0)
        paths = {s.path for s in picked}
        outside = [s for s in now.segments if s.path not in paths and (not leveled or s.level >= target)]
        rows = reads.latest(self._read(picked))
        low = min((s.min_key for s in picked if s.min_key is not None), default=None)
        high = max((s.max_key for s in picked if s.max_key is not None), default=None)
        covering = [s for s in outside if s.overlaps(low, high)]
        if covering:
            held = rows.where("tombstone").join(self._read(covering).select("key").distinct(), "key", "left_semi").select(*self.schema.names)
            rows = rows.where("not tombstone").unionByName(held)
        else:
            rows = rows.where("not tombstone")
        new = self._write_segments(rows, target, picked)
        pointers = {str(k): v for k, v in self.selector.moved(picked).items()} if leveled and selected is None else None
        done = self._install(picked, new, "segments", pointers)
        if pointers is not None:
            self.selector.pointers = {int(k): v for k, v in pointers.items()}
        return done

    def compact_all(self, most: int = 100) -> Version:
        """Rounds until the selector finds nothing due."""
        now = self.manifest.load()
        for _ in range(most):
            after = self.compact()
            if after.number == now.number:
                break
            now = after
        return now

    def compact_async(self) -> None:
        """One background worker at a time; a failure is raised by await_compaction(), not retried."""
        if self._worker is None or not self._worker.is_alive():

            def work():
                try:
                    self.compact_all()
                except CommitConflict:
                    pass  # another writer was first; its own check goes on
                except Exception as e:
                    self._failure = e

            self._worker = threading.Thread(target=work, daemon=True)
            self._worker.start()

    def await_compaction(self) -> None:
        if self._worker is not None:
            self._worker.join()
        if self._failure is not None:
            failure, self._failure = self._failure, None
            raise failure

    def settle(self) -> Version:
        """Flushes, waits, and merges everything into one level."""
        self.flush()
        self.await_compaction()
        now = self.manifest.load()
        return self.compact(list(now.segments), level=max((s.level for s in now.segments), default=0)) if len(now.segments) > 1 or any(s.tombstones for s in now.segments) else now

    def vacuum(self, keep: int = 1, older_than_s: float = 0) -> list[str]:
        """Deletes files that no kept version and no open snapshot of this handle names; returns what it deleted.

        Readers in other processes are safe for `older_than_s` seconds, so keep that above their longest query.
        """
        named = self.manifest.drop_before(keep, older_than_s)
        for pin in self._pins.values():
            named |= {s.path for s in (*pin.version.segments, *pin.version.tail)} | {s.bloom for s in pin.version.segments if s.bloom}
        plain = {_plain(p) for p in named}
        limit, deleted, files = time.time() - older_than_s, [], self.manifest.files
        for folder in ("data", "tail"):
            for name in files.names(f"{self.path}/{folder}"):
                p = f"{self.path}/{folder}/{name}"
                if any(n == _plain(p) or n.startswith(_plain(p) + "/") for n in plain):
                    continue
                if files.system(p).getFileStatus(files.path(p)).getModificationTime() / 1000 <= limit:
                    files.delete(p)
                    deleted.append(p)
        return deleted


def _stream(batch_id: str | None) -> tuple[str, int]:
    name, _, number = (batch_id or "").rpartition("-")
    return (name, int(number)) if number.isdigit() else (batch_id or "", 0)


def _replayed(v: Version, batch_id: str | None) -> bool:
    stream, number = _stream(batch_id)
    return batch_id is not None and v.batches.get(stream, -1) >= number


def _apart(segments: list[Segment], tail: list[Segment]) -> tuple[list[Segment], list[Segment]]:
    """(segments whose key range no other part touches, all other parts)."""
    parts = sorted((s for s in (*segments, *tail)), key=lambda s: s.min_key)
    alone, mixed, reach = [], list(tail), None
    names = {s.path for s in tail}
    for i, s in enumerate(parts):
        before = reach is not None and s.min_key <= reach
        after = i + 1 < len(parts) and parts[i + 1].min_key <= s.max_key
        reach = s.max_key if reach is None else max(reach, s.max_key)
        if s.path not in names:
            (mixed if before or after else alone).append(s)
    return alone, mixed


def _cut(shared, limit: int | None, id_type):
    def run(batches):
        import bisect

        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            batch = batch.take(pc.sort_indices(batch, [("key", "ascending")]))
            keys = batch.column("key").to_pylist()
            if not keys:
                continue
            asked, reach = shared.value
            # ranges that end before the batch begins, or begin after it ends, aren't looked at
            first, last = bisect.bisect_left(reach, keys[0]), bisect.bisect_right(asked, keys[-1], key=lambda r: r[0])
            at, ids = [], []
            for low, high, name in asked[first:last]:
                if high < keys[0]:
                    continue
                a, b = bisect.bisect_left(keys, low), bisect.bisect_right(keys, high)
                b = b if limit is None else min(b, a + limit)
                at.extend(range(a, b))
                ids.extend([name] * (b - a))
            if at:
                got = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), got.column("key"), got.column("value")], ["range_id", "key", "value"])

    return run


def _plain(path: str) -> str:
    """A path without scheme and host, as different writers give it."""
    path = path.split("://", 1)[-1] if "://" in path else path.removeprefix("file:")
    return "/" + path.split("/", 1)[1].lstrip("/") if "/" in path else path


def _encoded(key, kind: T.DataType) -> bytes:
    if isinstance(kind, T.StringType):
        return key.encode().replace(b"\0", b"\0\xff") + b"\0\0"
    if isinstance(kind, T.IntegerType):
        return (key + (1 << 31)).to_bytes(4, "big")
    return (key + (1 << 63)).to_bytes(8, "big")
