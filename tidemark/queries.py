"""The query catalog: every query by name, and its SQL, over two logs made of the driver's tables.

orders_log: key customer, seq order number, tombstone status F, value total price, a segment per 500 orders.
events_log: key user, seq event, tombstone type error, value, a segment per 1,000 events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import bloom, codec, workload
from tidemark.operators import compaction, merge, metrics
from tidemark.operators import latest as reads
from tidemark.operators.metrics import read_amplification
from tidemark.operators.running import counts_between, ranked
from tidemark.session import fresh_path, ship
from tidemark.sources.manifest import Segment

NAMES = {"key": "k", "seq": "seq", "tombstone": "tomb"}


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return t.select(
        F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "F").alias("tomb"),
        F.col("o_totalprice").alias("v"), F.expr("cast(o_orderkey div 500 as int)").alias("seg"),
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select(
        F.col("user_id").alias("k"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("tomb"),
        F.col("value").alias("v"), F.expr("cast(event_id div 1000 as int)").alias("seg"),
    )


ORDERS = "orders_log AS (SELECT o_custkey AS k, o_orderkey AS seq, o_orderstatus = 'F' AS tomb, o_totalprice AS v, (o_orderkey // 500)::INTEGER AS seg FROM orders)"
EVENTS = "events_log AS (SELECT user_id AS k, event_id AS seq, event_type = 'error' AS tomb, value AS v, (event_id // 1000)::INTEGER AS seg FROM events)"


def _latest_sql(log: str, where: str = "true") -> str:
    return f"SELECT k, max(seq) AS seq, arg_max(tomb, seq) AS tomb, arg_max(v, seq) AS v FROM {log} WHERE {where} GROUP BY k"


def _live_sql(log: str, where: str = "true") -> str:
    return f"SELECT * FROM ({_latest_sql(log, where)}) WHERE NOT tomb"


def segments(log: DataFrame) -> DataFrame:
    """Each segment's latest version per key, as flushes of the log leave them."""
    best = log.groupBy("seg", "k").agg(F.max_by(F.struct("seq", "tomb", "v"), "seq").alias("b"))
    return best.select("seg", "k", "b.seq", "b.tomb", "b.v")


SEGS = "segs AS (SELECT seg, k, max(seq) AS seq, arg_max(tomb, seq) AS tomb, arg_max(v, seq) AS v FROM {log} GROUP BY seg, k)"
#: Bytes of a record with a 4-byte key and an 8-byte value.
ROW_SQL = "(4 + 9 + CASE WHEN tomb THEN 0 ELSE 12 END)"


def _row_bytes():
    return F.lit(4) + codec.value_size(F.col("tomb"), F.lit(8))


def live_view(spark, d):
    return reads.live(orders_log(spark, d).drop("seg"), **NAMES)


def latest_raw(spark, d):
    return reads.latest(orders_log(spark, d).drop("seg"), "k")


def scan_range(spark, d):
    return reads.scan(events_log(spark, d).drop("seg"), 20, 90, **NAMES)


def scan_limit(spark, d):
    return reads.scan(orders_log(spark, d).drop("seg"), 100, None, 100, **NAMES)


def _probes(log: DataFrame, name: str) -> DataFrame:
    """Every key of the log and the number after it: some held, some not, as many as there are keys."""
    return log.select(F.explode(F.array(F.col("k"), F.col("k") + 1)).alias(name)).distinct()


PROBES = "probes AS (SELECT DISTINCT k FROM (SELECT k FROM {log} UNION ALL SELECT k + 1 FROM {log}))"


def multi_get(spark, d):
    log = events_log(spark, d).drop("seg")
    return reads.multi_get(log, _probes(log, "k"), **NAMES).select("k", "v")


def point_get(spark, d):
    return reads.get(orders_log(spark, d).drop("seg"), 137, **NAMES)


def time_travel(spark, d):
    return reads.live(reads.as_of(events_log(spark, d).drop("seg"), 5000), **NAMES)


def manifest(spark, d):
    return segments(events_log(spark, d)).groupBy("seg").agg(F.count("*").alias("entries"), F.min("k").alias("min_key"), F.max("k").alias("max_key"), F.max("seq").alias("max_seq"))


def segment_bytes(spark, d):
    return segments(orders_log(spark, d)).groupBy("seg").agg((F.lit(codec.FILE_HEAD) + F.sum(_row_bytes())).cast("long").alias("bytes"))


def sparse_index(spark, d):
    w = Window.partitionBy("seg").orderBy("k")
    return segments(events_log(spark, d)).select("seg", "k", (F.row_number().over(w) - 1).alias("place")).where("place % 16 = 0")


def read_amp_range(spark, d):
    log = events_log(spark, d)
    m = segments(log).groupBy("seg").agg(F.min("k").alias("min_key"), F.max("k").alias("max_key"))
    return read_amplification(m, _probes(log, "key"))


def floor_key(spark, d):
    log = events_log(spark, d)
    return reads.floor_key(reads.live(log, **NAMES), _probes(log, "probe"), "k")


def ceiling_key(spark, d):
    log = orders_log(spark, d)
    return reads.ceiling_key(reads.live(log, **NAMES), _probes(log, "probe"), "k")


def merge_drop_all(spark, d):
    """All segments merged into one: nothing older is left, so no tombstone survives."""
    log = segments(orders_log(spark, d)).withColumnRenamed("tomb", "tombstone").drop("seg")
    return merge.merge_drop_all(log, key="k").withColumnRenamed("tombstone", "tomb")


def merge_retain(spark, d):
    """Every second segment is merged, the others stay outside and are what tombstones may still have to hide."""
    log = segments(orders_log(spark, d)).withColumnRenamed("tomb", "tombstone")
    return merge.merge_retain(log.where("seg % 2 = 1").drop("seg"), log.where("seg % 2 = 0"), "k").withColumnRenamed("tombstone", "tomb")


def _levelled(log: DataFrame, target: int) -> DataFrame:
    """(k, file) of the live rows as one merge cuts them into files."""
    rows = reads.live(log.drop("seg"), **NAMES).withColumn("bytes", _row_bytes().cast("long"))
    return merge.exact_split(rows, "bytes", target, "k")


def level_split(spark, d):
    return _levelled(events_log(spark, d), 300).select("k", "file")


def keys_per_file(spark, d):
    return _levelled(orders_log(spark, d), 2510).groupBy("file").agg(F.count("*").alias("entries"))


def _bounds(spark, d):
    return _levelled(orders_log(spark, d), 2510).groupBy("file").agg(F.min("k").alias("min_key"), F.max("k").alias("max_key"))


def segment_overlap(spark, d):
    return _bounds(spark, d).where("min_key <= 400 and max_key >= 300")


def read_amp_levelled(spark, d):
    return read_amplification(_bounds(spark, d), _probes(orders_log(spark, d), "key")).agg((F.sum("consulted") / F.count("*")).alias("read_amp"))


def space_amp(spark, d):
    log = orders_log(spark, d)
    n = segments(log).agg(F.count("*").alias("n"))
    m = reads.live(log.drop("seg"), **NAMES).agg(F.count("*").alias("m"))
    return n.join(F.broadcast(m)).select((F.col("n") / F.col("m")).alias("space_amp"))  # one row each


def write_amp(spark, d):
    log = orders_log(spark, d)
    put = log.agg(F.sum(_row_bytes()).alias("put"))
    files = segments(log).groupBy("seg").agg((F.lit(codec.FILE_HEAD) + F.sum(_row_bytes())).alias("b")).agg(F.sum("b").alias("written"))
    return files.join(F.broadcast(put)).select((F.col("written") / F.col("put")).alias("write_amp"))  # one row each


def flush_segments(spark, d):
    """The order log cut into flushes by the bytes that a write buffer counts; puts and bytes of each."""
    from tidemark.operators.flush import flush_boundaries

    log = orders_log(spark, d).select(F.col("k").cast("int").alias("k"), "seq", "tomb")
    cut = flush_boundaries(log, 8192, F.lit(8), "k", "seq", "tomb")
    return cut.groupBy("flush").agg(F.count("*").alias("puts"), F.countDistinct("k").alias("keys"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def tombstone_count(spark, d):
    return segments(orders_log(spark, d)).groupBy("seg").agg(F.count_if("tomb").alias("tombstones"))


def version_diff(spark, d):
    return reads.version_diff(orders_log(spark, d).drop("seg"), 7000, 9000, "k", "seq", "tomb", "v")


def shadowed_versions(spark, d):
    return reads.shadowed_versions(orders_log(spark, d), "k")


def encoded_key_hex(spark, d):
    return orders_log(spark, d).select("k").distinct().select("k", F.hex(codec.encode_int(F.col("k"))).alias("encoded"))


def key_round_trip(spark, d):
    """Keys decoded from their encodings: numbers and texts, also ones that hold a NUL."""
    t = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("int").alias("k"), F.replace(F.col("c_name"), F.lit("#"), F.lit("\0")).alias("name"))
    back = codec.decode_string(codec.encode_string(F.col("name")))
    return t.select(codec.decode_int(codec.encode_int(F.col("k"))).alias("k"), F.hex(back).alias("name_hex"), F.octet_length(codec.encode_string(F.col("name"))).alias("size"))


def key_order(spark, d):
    """Encoded string keys order as their texts do, byte by byte."""
    t = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("name")).distinct()
    return ranked(t.withColumn("raw", codec.encode_string(F.col("name"))), ["raw"]).select("name", F.hex("raw").alias("encoded"), "place")


def ycsb_e_ranges(spark, d):
    """Short scans from every customer's key on: how many live keys each finds."""
    c = F.col("c_custkey")
    ranges = spark.read.parquet(f"{d}/customer.parquet").select(c.alias("range_id"), c.alias("low"), (c + c % 10).alias("high"))
    live = reads.live(orders_log(spark, d).drop("seg"), **NAMES)
    return counts_between(live, ranges, "k").withColumnRenamed("range_id", "r")


def read_modify_write(spark, d):
    """Every live key's value is raised by one in a new version; the state after it."""
    log = orders_log(spark, d).drop("seg")
    now = reads.live(log, **NAMES)
    new = now.select("k", (F.col("seq") + 1_000_000_000).alias("seq"), F.lit(False).alias("tomb"), (F.col("v") + 1).alias("v"))
    return reads.live(log.unionByName(new), **NAMES)


def _grown(spark, d) -> list[Segment]:
    """A manifest's rows, sizes spread over several tiers."""
    rows = segment_bytes(spark, d).withColumn("grown", (F.col("bytes") * (F.col("seg") % 5 + 1)).cast("long")).orderBy("grown", "seg").collect()
    return [Segment(str(r.seg), 0, 0, 0, None, None, 0, r.grown) for r in rows]


def size_tiered_buckets(spark, d):
    """Which size tier each segment falls into, the tier anchored at its smallest member."""
    tiers = compaction.SizeTiered(least=1).tiers(_grown(spark, d))
    out = [(int(s.path), i, s.bytes) for i, t in enumerate(tiers) for s in t]
    return spark.createDataFrame(out, "seg int, tier int, bytes long")


def size_tiered_selection(spark, d):
    """What size-tiered compaction merges next: the tier of the smallest members that has four."""
    return spark.createDataFrame([(int(s.path),) for s in compaction.SizeTiered(least=4).select(_grown(spark, d))], "seg int")


def full_selection(spark, d):
    """What full compaction merges: all segments once there are enough, none before."""
    found = _grown(spark, d)
    out = [(n, int(s.path)) for n in (10, len(found) + 1) for s in compaction.Full(n).select(found)]
    return spark.createDataFrame([(seg,) for n, seg in out], "seg int")


def leveled_selection(spark, d):
    """What levelled compaction merges: level 0 with what it overlaps; level 1 from its pointer on; the same with the pointer past all."""
    rows = segments(orders_log(spark, d)).groupBy("seg").agg(F.sum(_row_bytes()).cast("long").alias("bytes"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("seg").collect()  # a manifest
    at = lambda r: (r.lo, r.hi) if r.seg % 3 == 0 else (100 * (r.seg // 3), 100 * (r.seg // 3) + 99)
    found = [Segment(str(r.seg), r.seg % 3, 0, 0, *at(r), 0, r.bytes) for r in rows]
    deep = [s for s in found if s.level]
    cases = {"level 0": (compaction.Leveled(), found)} | {f"level 1 after {p}": (compaction.Leveled(base=1000, pointers={1: p}), deep) for p in (450, 10**9)}
    return spark.createDataFrame([(name, int(s.path)) for name, (c, among) in cases.items() for s in c.select(among)], "case string, seg int")


def bloom_fpr(spark, d):
    """Keys of the log are all found in its filter, others at about the filter's rate."""
    ship(spark)
    log = orders_log(spark, d).select("k").distinct()
    n = log.count()
    shape = bloom.Shape.of(n, 0.02)
    one = log.withColumn("g", F.lit(0))
    raw = bytes(bloom.build_filters(one, "g", codec.encode_long(F.col("k")), shape).first().bloom)
    may = bloom.probe(raw, shape)
    probes = log.select("k", F.lit(True).alias("member")).union(spark.range(1_000_000, 1_020_000).select(F.col("id"), F.lit(False)))
    return probes.select("member", may(codec.encode_long(F.col("k"))).alias("hit")).groupBy("member").agg(F.count("*").alias("keys"), F.count_if("hit").alias("hits"))


def absent_keys(spark, d):
    """(k, seg): keys that a segment definitely doesn't hold, by its bounds and its filter; each key asks one segment."""
    segs = segments(orders_log(spark, d))
    told = segs.groupBy("seg").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n"))
    most, count = told.agg(F.max("n"), F.count("*")).first()
    shape = bloom.Shape.of(most, 0.02)
    filters = bloom.build_filters(segs, "seg", codec.encode_long(F.col("k")), shape).join(told, "seg")
    probes = _probes(segs, "k").withColumn("seg", (F.col("k") % count).cast("int"))
    asked = probes.select("seg", "k", codec.encode_long(F.col("k")).alias("raw"))
    return bloom.definitely_absent(filters, asked, "seg", "k", shape)


def _framed(log: DataFrame) -> DataFrame:
    """(path, content): each segment of the event log as the bytes of one log file, path its number."""
    ship(log.sparkSession)
    from tidemark.sources import wal

    rows = log.select(F.col("k").cast("int").alias("k"), "seq", "tomb", F.encode(F.col("seq").cast("string"), "UTF-8").alias("v"), "seg")

    def framed(part):
        import pyarrow as pa

        part = part.sort_by("seq")
        columns = zip(*(part.column(c).to_pylist() for c in ("k", "seq", "tomb", "v")), strict=True)
        raw = wal.frame([(k, s, None if t else v) for k, s, t, v in columns])
        return pa.table({"path": pa.array([str(part.column("seg")[0])]), "content": pa.array([raw], pa.binary())})

    return rows.groupBy("seg").applyInArrow(framed, "path string, content binary")  # a segment's puts


def sstable_scan(spark, d):
    """Each segment of the event log in the row format of data files, read back: every entry, and how many index entries its file has."""
    ship(spark)
    from tidemark.sources import sstable

    rows = segments(events_log(spark, d)).select(F.col("k").cast("int").alias("k"), "seq", "tomb", F.encode(F.col("seq").cast("string"), "UTF-8").alias("v"), "seg")

    def stored(part):
        import struct

        import pyarrow as pa

        part = part.sort_by("k")
        columns = zip(*(part.column(c).to_pylist() for c in ("k", "seq", "tomb", "v")), strict=True)
        data, index, _ = sstable.write_bytes([(k, s, None if t else v) for k, s, t, v in columns])
        return pa.table({"path": pa.array([f"{part.column('seg')[0]}:{struct.unpack_from('>i', index)[0]}"]), "content": pa.array([data], pa.binary())})

    back = sstable.decoded(rows.groupBy("seg").applyInArrow(stored, "path string, content binary"))
    name = F.split("file", ":")
    return back.select(name[0].cast("int").alias("seg"), name[1].cast("int").alias("index_entries"), F.col("key").alias("k"), "seq", "tombstone", F.decode("value", "UTF-8").alias("v"))


def _damaged(files: DataFrame) -> DataFrame:
    """The logs with their middle record damaged in a way that the file's number tells; every sixth stays whole."""

    def run(batches):
        from tidemark.sources import wal

        def harmed(path, raw):
            starts, at = [], 0
            while at < len(raw):
                starts.append(at)
                at += wal.HEAD.size + wal.HEAD.unpack_from(raw, at)[3]
            m, kind = starts[len(starts) // 2], int(path) % 6
            change = {2: (m, 4), 3: (m + 16, 4), 5: (m + 8, 8)}.get(kind)  # magic, length, tag
            if kind == 1:
                return raw[: m + 10]
            if kind == 4:
                return raw[: m + 20] + bytes([raw[m + 20] ^ 1]) + raw[m + 21 :]
            return raw[: change[0]] + b"\0" * change[1] + raw[change[0] + change[1] :] if change else raw

        for b in batches:
            yield from wal.some((path, harmed(path, raw)) for path, raw in wal.logs(b))

    return files.mapInArrow(run, "path string, content binary")


def wal_replay(spark, d):
    """The event log written as log files, read back, and merged: as the live view."""
    from tidemark.sources import wal

    back = wal.recovered(wal.decoded(_framed(events_log(spark, d))))
    return reads.live(back).select(F.col("key").cast("long").alias("k"), "seq", F.decode("value", "UTF-8").cast("long").alias("v"))


def _replays(files: DataFrame) -> DataFrame:
    from tidemark.sources import wal

    got = wal.decoded(files).groupBy("file", "reason", "offset").agg(F.count("seq").alias("records"))
    return got.select(F.col("file").cast("int").alias("seg"), "reason", "offset", "records")


def wal_stop_reasons(spark, d):
    """Logs of the event table's segments, most of them damaged: why, where and after how many records replay stops."""
    return _replays(_damaged(_framed(events_log(spark, d))))


def wal_truncated(spark, d):
    """The damaged logs cut where replay stopped: the same records, and a clean end."""
    from tidemark.sources import wal

    return _replays(wal.truncated(_damaged(_framed(events_log(spark, d)))))


def _filled_store(spark, log, cuts, flush: int | None = None, **options):
    """A store of a log taken in batches that end at the given sequence numbers, the first `flush` of them flushed each."""
    from tidemark.plans.store import Store

    store = Store(spark, fresh_path(spark, "store"), T.LongType(), **options)
    for i, (low, high) in enumerate(zip((0, *cuts), (*cuts, 1 << 40), strict=True)):
        _apply(store, log, low, high)
        if flush is None or i < flush:
            store.flush()
    return store


def _apply(store, log, low, high):
    rows = log.where((F.col("seq") >= low) & (F.col("seq") < high))
    value = F.when(~F.col("tomb"), F.encode(F.col("v").cast("string"), "UTF-8"))
    store.apply_batch(rows.select(F.col("k").alias("key"), F.col("tomb").alias("tombstone"), value.alias("value"), F.col("seq").alias("order")))


def _valued(found: DataFrame, *more: str) -> DataFrame:
    return found.select(F.col("key").alias("k"), F.decode("value", "UTF-8").cast("double").alias("v"), *more)


def store_scan(spark, d):
    """Three flushed batches, scanned between two keys."""
    return _valued(_filled_store(spark, events_log(spark, d), (3000, 6000)).scan(20, 90))


def store_tail(spark, d):
    """One flushed batch and one that is not, closed and opened again: a scan reads segment and tail together."""
    from tidemark.plans.store import Store

    store = _filled_store(spark, orders_log(spark, d), (6000,), flush=1)
    store.close()
    return _valued(Store(spark, store.path).scan())


def store_compacted(spark, d):
    """Three batches after compaction: one merged level, the same live rows, no tombstones left."""
    store = _filled_store(spark, events_log(spark, d), (3000, 6000))
    store.settle()
    return _valued(store.snapshot().log(), "tombstone")


def store_partial(spark, d):
    """The first and the last of three segments are merged, the one between stays outside: tombstones stay where it holds their key."""
    store = _filled_store(spark, orders_log(spark, d), (3000, 6000))
    first, _, last = sorted(store.manifest.load().segments, key=lambda s: s.max_seq)
    merged = store.compact([first, last]).segments[-1]
    return _valued(store.snapshot()._rows([merged]), "tombstone")


def store_snapshot(spark, d):
    """A snapshot taken before a batch, a compaction and a vacuum reads what it read before."""
    log = events_log(spark, d)
    store = _filled_store(spark, log.where("seq < 6000"), (3000,))
    snapshot = store.snapshot()
    _apply(store, log, 6000, 1 << 40)
    store.settle()
    store.vacuum()
    return _valued(snapshot.scan())


def store_background(spark, d):
    """Flushes that start compactions in the background, awaited: the same live rows."""
    store = _filled_store(spark, orders_log(spark, d), (5000,), selector=compaction.Full(2), background=True)
    store.await_compaction()
    return _valued(store.scan())


def latencies(spark, d):
    """Mean, median, 99th percentile and maximum of the events' values by type, by place in the sorted list."""
    t = spark.read.parquet(f"{d}/events.parquet")
    return metrics.latencies(t.select("event_type", "value"), "event_type", "value")


def load_order(spark, d):
    """A shuffled load of as many keys as there are customers: each key's generator value."""
    n = spark.read.parquet(f"{d}/customer.parquet").count()
    return workload.key_order(spark, n)


def stream_latest(spark, d):
    """The event log as a stream, ingested into a store and scanned."""
    import uuid

    from tidemark.plans.store import Store
    from tidemark.streaming.ingest import ingest

    root = fresh_path(spark, "stream")
    source = f"{root}-source"
    log = events_log(spark, d)
    value = F.when(~F.col("tomb"), F.encode(F.col("v").cast("string"), "UTF-8"))
    rows = log.select(F.col("k").alias("key"), F.col("tomb").alias("tombstone"), value.alias("value"), F.col("seq").alias("order"))
    rows.repartitionByRange(3, "order").write.parquet(source)
    store = Store(spark, root, T.LongType())
    query = ingest(spark.readStream.schema(rows.schema).parquet(source), store, f"{root}-checkpoint", uuid.uuid4().hex)
    query.awaitTermination()
    return store.scan().select(F.col("key").alias("k"), F.decode("value", "UTF-8").cast("double").alias("v"))


QUERIES = {
    f.__name__: f
    for f in (
        live_view, latest_raw, scan_range, scan_limit, multi_get, point_get, time_travel, manifest, segment_bytes, sparse_index, read_amp_range, floor_key,
        ceiling_key, merge_drop_all, merge_retain, level_split, keys_per_file, segment_overlap, read_amp_levelled, space_amp, write_amp, tombstone_count,
        version_diff, shadowed_versions, encoded_key_hex, key_round_trip, key_order, ycsb_e_ranges, read_modify_write, size_tiered_buckets, size_tiered_selection, full_selection,
        leveled_selection, bloom_fpr, absent_keys, sstable_scan, wal_replay, wal_stop_reasons, wal_truncated, store_scan, store_tail, store_compacted, store_partial, store_snapshot,
        store_background, latencies, load_order, stream_latest, flush_segments,
    )
}

#: Files are cut row by row: a file ends with the row by which it reaches the target. For SQL that begins WITH RECURSIVE.
_FILES = (
    "rows AS (SELECT *, row_number() OVER (ORDER BY k) AS i, (4 + 9 + 12)::BIGINT AS bytes FROM ({live})), "
    "files AS (SELECT i, k, 0 AS file, bytes AS held FROM rows WHERE i = 1 UNION ALL "
    "SELECT r.i, r.k, CASE WHEN f.held >= {target} THEN f.file + 1 ELSE f.file END, CASE WHEN f.held >= {target} THEN 0 ELSE f.held END + r.bytes FROM files f JOIN rows r ON r.i = f.i + 1)"
)
_LEVELLED = _FILES.format(live=_live_sql("orders_log"), target=2510)
_BOUNDS = "bounds AS (SELECT file, min(k) AS min_key, max(k) AS max_key FROM files GROUP BY file)"
_TIERS = (
    f"WITH RECURSIVE {ORDERS}, {SEGS.format(log='orders_log')}, b AS (SELECT seg, ((16 + sum({ROW_SQL})) * (seg % 5 + 1))::BIGINT AS bytes FROM segs GROUP BY seg), "
    "o AS (SELECT *, row_number() OVER (ORDER BY bytes, seg) AS i FROM b), "
    "f AS (SELECT i, seg, bytes, 0 AS tier, bytes AS anchor FROM o WHERE i = 1 UNION ALL "
    "SELECT o.i, o.seg, o.bytes, CASE WHEN o.bytes <= 1.5 * f.anchor THEN f.tier ELSE f.tier + 1 END, CASE WHEN o.bytes <= 1.5 * f.anchor THEN f.anchor ELSE o.bytes END FROM f JOIN o ON o.i = f.i + 1) "
)
#: The level-1 case of levelled selection: the first segment after the pointer, else the first, and what it overlaps below.
_LEVEL_1 = (
    "SELECT 'level 1 after {p}' AS case_, m.seg FROM m, (SELECT lo AS a, hi AS b FROM m WHERE level = 1 ORDER BY lo <= {p}, lo LIMIT 1) t "
    "WHERE (SELECT sum(bytes) FROM m WHERE level = 1) >= 1000 AND ((level = 1 AND lo = a) OR (level = 2 AND lo <= b AND hi >= a))"
)


def _fnv(basis: int) -> str:
    """FNV-1a over the eight big-endian bytes of u, as a signed number."""
    h = f"{basis}::UBIGINT"
    for i in range(8):
        h = f"((xor({h}, (u >> {56 - 8 * i}) & 255))::HUGEINT * {bloom.PRIME} % 18446744073709551616)::UBIGINT"
    return f"(CASE WHEN {h} >= 9223372036854775808 THEN {h}::HUGEINT - 18446744073709551616 ELSE {h}::HUGEINT END)"


#: Bit numbers of keys k of a table: k probes h1 + i * h2 in 64-bit arithmetic, modulo the bits of a filter for n keys.
_SHAPE = "shape AS (SELECT bits, greatest(1, round(bits / n * ln(2)))::INTEGER AS probes FROM (SELECT n, (ceil(-n * ln(0.02) / ln(2) ** 2)::BIGINT | 1) AS bits FROM ({n})))"
_WRAPPED = "(((h1 + i * h2 + 9223372036854775808) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 - 9223372036854775808)"
_BITS = (
    f"(SELECT *, ({_WRAPPED} % bits + bits) % bits AS bit FROM (SELECT *, unnest(range(probes)) AS i FROM (SELECT *, {_fnv(bloom.BASIS)} AS h1, {_fnv(bloom.BASIS2)} AS h2 "
    "FROM (SELECT *, (k::HUGEINT + 9223372036854775808)::UBIGINT AS u FROM {table}), shape)))"
)
def _mixed_sql(z: str, shift: int, times: int) -> str:
    """One step of the generator's finaliser on an unsigned 64-bit number."""
    x = f"xor({z}, {z} >> {shift})"  # multiplied in halves of 32 bits: the whole product has 128
    return f"(((({x} >> 32)::HUGEINT * {times} % 4294967296) * 4294967296 + ({x} & 4294967295)::HUGEINT * {times}) % 18446744073709551616)::UBIGINT"


_RECORD = "(20 + 4 + 9 + CASE WHEN tomb THEN 0 ELSE 4 + length(seq::VARCHAR) END)"
_REPLAYS = (
    f"WITH {EVENTS}, r AS (SELECT seg, {_RECORD} AS b, row_number() OVER (PARTITION BY seg ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY seg) AS n FROM events_log), "
    "g AS (SELECT seg, sum(b) AS o, count(*) AS c FROM r WHERE seg % 6 = 0 OR i < n // 2 GROUP BY seg) "
)

SQL = {
    "live_view": f"WITH {ORDERS} {_live_sql('orders_log')}",
    "latest_raw": f"WITH {ORDERS} {_latest_sql('orders_log')}",
    "scan_range": f"WITH {EVENTS} {_live_sql('events_log', 'k BETWEEN 20 AND 90')} ORDER BY k",
    "scan_limit": f"WITH {ORDERS} {_live_sql('orders_log', 'k >= 100')} ORDER BY k LIMIT 100",
    "multi_get": f"WITH {EVENTS}, {PROBES.format(log='events_log')} SELECT p.k, v FROM probes p LEFT JOIN ({_live_sql('events_log')}) l ON l.k = p.k",
    "point_get": f"WITH {ORDERS} {_live_sql('orders_log', 'k = 137')}",
    "time_travel": f"WITH {EVENTS} {_live_sql('events_log', 'seq <= 5000')}",
    "manifest": f"WITH {EVENTS}, {SEGS.format(log='events_log')} SELECT seg, count(*) AS entries, min(k) AS min_key, max(k) AS max_key, max(seq) AS max_seq FROM segs GROUP BY seg",
    "segment_bytes": f"WITH {ORDERS}, {SEGS.format(log='orders_log')} SELECT seg, (16 + sum({ROW_SQL}))::BIGINT AS bytes FROM segs GROUP BY seg",
    "sparse_index": f"WITH {EVENTS}, {SEGS.format(log='events_log')} SELECT * FROM (SELECT seg, k, (row_number() OVER (PARTITION BY seg ORDER BY k) - 1)::INTEGER AS place FROM segs) WHERE place % 16 = 0",
    "read_amp_range": f"WITH {EVENTS}, {PROBES.format(log='events_log')}, {SEGS.format(log='events_log')}, m AS (SELECT seg, min(k) AS lo, max(k) AS hi FROM segs GROUP BY seg) "
    "SELECT p.k AS key, count(seg) AS consulted FROM probes p LEFT JOIN m ON p.k BETWEEN lo AND hi GROUP BY p.k",
    "floor_key": f"WITH {EVENTS}, {PROBES.format(log='events_log')} SELECT p.k AS probe, (SELECT max(k) FROM ({_live_sql('events_log')}) WHERE k <= p.k) AS floor FROM probes p",
    "ceiling_key": f"WITH {ORDERS}, {PROBES.format(log='orders_log')} SELECT p.k AS probe, (SELECT min(k) FROM ({_live_sql('orders_log')}) WHERE k >= p.k) AS ceiling FROM probes p",
    "merge_drop_all": f"WITH {ORDERS} {_live_sql('orders_log')}",
    "merge_retain": f"WITH {ORDERS} SELECT * FROM ({_latest_sql('orders_log', 'seg % 2 = 1')}) WHERE NOT tomb OR k IN (SELECT k FROM orders_log WHERE seg % 2 = 0)",
    "level_split": f"WITH RECURSIVE {EVENTS}, {_FILES.format(live=_live_sql('events_log'), target=300)} SELECT k, file FROM files",
    "keys_per_file": f"WITH RECURSIVE {ORDERS}, {_LEVELLED} SELECT file, count(*) AS entries FROM files GROUP BY file",
    "segment_overlap": f"WITH RECURSIVE {ORDERS}, {_LEVELLED}, {_BOUNDS} SELECT * FROM bounds WHERE min_key <= 400 AND max_key >= 300",
    "read_amp_levelled": f"WITH RECURSIVE {ORDERS}, {_LEVELLED}, {_BOUNDS}, {PROBES.format(log='orders_log')}, n AS (SELECT p.k, count(file) AS c FROM probes p LEFT JOIN bounds ON p.k BETWEEN min_key AND max_key GROUP BY p.k) "
    "SELECT sum(c)::DOUBLE / count(*) AS read_amp FROM n",
    "space_amp": f"WITH {ORDERS}, {SEGS.format(log='orders_log')} SELECT (SELECT count(*) FROM segs)::DOUBLE / (SELECT count(*) FROM ({_live_sql('orders_log')})) AS space_amp",
    "write_amp": f"WITH {ORDERS}, {SEGS.format(log='orders_log')}, w AS (SELECT 16 + sum({ROW_SQL}) AS b FROM segs GROUP BY seg) SELECT (SELECT sum(b) FROM w)::DOUBLE / (SELECT sum({ROW_SQL}) FROM orders_log) AS write_amp",
    "tombstone_count": f"WITH {ORDERS}, {SEGS.format(log='orders_log')} SELECT seg, count(*) FILTER (tomb) AS tombstones FROM segs GROUP BY seg",
    "version_diff": f"WITH {ORDERS}, a AS ({_live_sql('orders_log', 'seq <= 7000')}), b AS ({_live_sql('orders_log', 'seq <= 9000')}) "
    "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS old, b.v AS new "
    "FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v",
    "shadowed_versions": f"WITH {ORDERS} SELECT k, count(*) - 1 AS shadowed FROM orders_log GROUP BY k",
    "encoded_key_hex": f"WITH {ORDERS} SELECT DISTINCT k, lpad(upper(to_hex(k + 2147483648)), 8, '0') AS encoded FROM orders_log",
    "key_round_trip": "SELECT c_custkey::INTEGER AS k, hex(encode(n)) AS name_hex, octet_length(encode(n)) + (length(n) - length(replace(n, chr(0), ''))) + 2 AS size FROM (SELECT c_custkey, replace(c_name, '#', chr(0)) AS n FROM customer)",
    "sstable_scan": f"WITH {EVENTS}, {SEGS.format(log='events_log')} SELECT seg, ((count(*) OVER (PARTITION BY seg) + 15) // 16)::INTEGER AS index_entries, k::INTEGER AS k, seq, tomb AS tombstone, CASE WHEN NOT tomb THEN seq::VARCHAR END AS v FROM segs",
    "key_order": "SELECT c_name AS name, hex(encode(c_name)) || '0000' AS encoded, row_number() OVER (ORDER BY c_name) AS place FROM (SELECT DISTINCT c_name FROM customer)",
    "ycsb_e_ranges": f"WITH {ORDERS} SELECT c_custkey AS r, count(k) AS n FROM customer LEFT JOIN ({_live_sql('orders_log')}) l ON k BETWEEN c_custkey AND c_custkey + c_custkey % 10 GROUP BY c_custkey",
    "read_modify_write": f"WITH {ORDERS} SELECT k, seq + 1000000000 AS seq, tomb, v + 1 AS v FROM ({_live_sql('orders_log')})",
    "size_tiered_buckets": _TIERS + "SELECT seg, tier, bytes FROM f",
    "size_tiered_selection": _TIERS + "SELECT seg FROM f WHERE tier = (SELECT min(tier) FROM (SELECT tier FROM f GROUP BY tier HAVING count(*) >= 4))",
    "full_selection": f"WITH {ORDERS}, {SEGS.format(log='orders_log')} SELECT seg FROM (SELECT DISTINCT seg FROM segs) WHERE (SELECT count(DISTINCT seg) FROM segs) >= 10",
    "leveled_selection": f"WITH {ORDERS}, {SEGS.format(log='orders_log')}, m AS (SELECT seg, seg % 3 AS level, sum({ROW_SQL}) AS bytes, CASE WHEN seg % 3 = 0 THEN min(k) ELSE 100 * (seg // 3) END AS lo, "
    "CASE WHEN seg % 3 = 0 THEN max(k) ELSE 100 * (seg // 3) + 99 END AS hi FROM segs GROUP BY seg), h AS (SELECT count(*) AS n, min(lo) AS a, max(hi) AS b FROM m WHERE level = 0) "
    "SELECT case_ AS \"case\", seg FROM (SELECT 'level 0' AS case_, seg FROM m, h WHERE n >= 4 AND (level = 0 OR (level = 1 AND lo <= b AND hi >= a)) UNION ALL "
    + _LEVEL_1.format(p=450) + " UNION ALL " + _LEVEL_1.format(p=10**9) + ")",
    "bloom_fpr": f"WITH {ORDERS}, keys AS (SELECT DISTINCT k FROM orders_log), {_SHAPE.format(n='SELECT count(*) AS n FROM keys')}, asked AS (SELECT k, true AS member FROM keys UNION ALL SELECT range, false FROM range(1000000, 1020000)), "
    f"own AS (SELECT DISTINCT bit FROM {_BITS.format(table='keys')}), probed AS (SELECT member, k, count(o.bit) = max(probes) AS hit FROM {_BITS.format(table='asked')} a LEFT JOIN own o ON o.bit = a.bit GROUP BY member, k) "
    "SELECT member, count(*) AS keys, count(*) FILTER (hit) AS hits FROM probed GROUP BY member",
    "absent_keys": f"WITH {ORDERS}, {SEGS.format(log='orders_log')}, {PROBES.format(log='segs')}, told AS (SELECT seg, min(k) AS lo, max(k) AS hi, count(*) AS n FROM segs GROUP BY seg), {_SHAPE.format(n='SELECT max(n) AS n FROM told')}, "
    f"asked AS (SELECT k, (k % (SELECT count(*) FROM told))::INTEGER AS seg FROM probes), own AS (SELECT DISTINCT seg, bit FROM {_BITS.format(table='segs')}), "
    f"probed AS (SELECT a.seg, a.k, count(o.bit) = max(probes) AS hit FROM {_BITS.format(table='asked')} a LEFT JOIN own o ON o.seg = a.seg AND o.bit = a.bit GROUP BY a.seg, a.k) "
    "SELECT p.k, p.seg FROM probed p JOIN told t ON t.seg = p.seg WHERE p.k < lo OR p.k > hi OR NOT hit",
    "wal_replay": f"WITH {EVENTS} SELECT k, seq, seq AS v FROM ({_live_sql('events_log')})",
    "wal_stop_reasons": _REPLAYS + "SELECT seg, ['CLEAN_EOF', 'TRUNCATED', 'BAD_MAGIC', 'INVALID_LENGTH', 'CHECKSUM_MISMATCH', 'STALE_RECORD'][seg % 6 + 1] AS reason, o::BIGINT AS offset, c AS records FROM g",
    "wal_truncated": _REPLAYS + "SELECT seg, 'CLEAN_EOF' AS reason, o::BIGINT AS offset, c AS records FROM g",
    "flush_segments": f"WITH RECURSIVE {ORDERS}, r AS (SELECT k, seq, CASE WHEN tomb THEN 9 ELSE 21 END AS vb, lag(seq) OVER w AS before, lag(CASE WHEN tomb THEN 9 ELSE 21 END) OVER w AS old FROM orders_log WINDOW w AS (PARTITION BY k ORDER BY seq)), "
    "f AS (SELECT -1 AS flush, -1::BIGINT AS a, -1::BIGINT AS b UNION ALL SELECT flush + 1, b, (SELECT min(seq) FROM (SELECT seq, sum(CASE WHEN before > f.b THEN vb - old ELSE 4 + vb END) OVER (ORDER BY seq) AS held FROM r WHERE seq > f.b) WHERE held >= 8192) "
    "FROM f WHERE b IS NOT NULL) "
    "SELECT CASE WHEN f.b IS NULL THEN -1 ELSE flush END AS flush, count(*) AS puts, count(DISTINCT k) AS keys, min(seq) AS first_seq, max(seq) AS last_seq "
    "FROM f JOIN r ON seq > a AND (f.b IS NULL OR seq <= f.b) WHERE flush >= 0 GROUP BY ALL",
    "store_scan": f"WITH {EVENTS} SELECT k, v FROM ({_live_sql('events_log')}) WHERE k BETWEEN 20 AND 90",
    "store_tail": f"WITH {ORDERS} SELECT k, v FROM ({_live_sql('orders_log')})",
    "store_partial": f"WITH {ORDERS} SELECT k, CASE WHEN NOT tomb THEN v END AS v, tomb AS tombstone FROM ({_latest_sql('orders_log', 'seq < 3000 OR seq >= 6000')}) WHERE NOT tomb OR k IN (SELECT k FROM orders_log WHERE seq >= 3000 AND seq < 6000)",
    "store_snapshot": f"WITH {EVENTS} SELECT k, v FROM ({_live_sql('events_log', 'seq < 6000')})",
    "store_background": f"WITH {ORDERS} SELECT k, v FROM ({_live_sql('orders_log')})",
    "latencies": "SELECT event_type, avg(value) AS avg, list_sort(list(value))[count(*) // 2 + 1] AS p50, list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.99)::BIGINT) + 1] AS p99, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "load_order": "WITH a AS (SELECT range AS id, ((42 + (range + 1)::HUGEINT * 11400714819323198485) % 18446744073709551616)::UBIGINT AS z FROM range((SELECT count(*) FROM customer))), "
    f"b AS (SELECT id, {_mixed_sql('z', 30, 13787848793156543929)} AS z FROM a), c AS (SELECT id, {_mixed_sql('z', 27, 10723151780598845931)} AS z FROM b), e AS (SELECT id, xor(z, z >> 31)::HUGEINT AS z FROM c) "
    "SELECT id, (CASE WHEN z >= 9223372036854775808 THEN z - 18446744073709551616 ELSE z END)::BIGINT AS value, 'user' || lpad(id::VARCHAR, 12, '0') AS key FROM e",
    "store_compacted": f"WITH {EVENTS} SELECT k, v, false AS tombstone FROM ({_live_sql('events_log')})",
    "stream_latest": f"WITH {EVENTS} SELECT k, v FROM ({_live_sql('events_log')})",
}
