"""Checksummed write-ahead log files: framing, replay with the reason it stopped, and replay of many files as a DataFrame.

A record: magic, CRC-32C of all that follows the checksum, tag (the greatest sequence number so far), payload length, payload.
The payload is the encoded key and the value (sequence number, tombstone flag, then length and bytes of a live value).
Replay takes records until the first that isn't whole and in order; what stands before it is kept. One file is read by one
task, so many small files spread well and one long file streams.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship

#: The magic, the head's layout, and the reflected polynomial of CRC-32C.
MAGIC, HEAD, POLYNOMIAL = b"WAL2", struct.Struct(">4sIqi"), 0x82F63B78

CLEAN, TRUNCATED, BAD_MAGIC, STALE, LENGTH, CHECKSUM = "CLEAN_EOF", "TRUNCATED", "BAD_MAGIC", "STALE_RECORD", "INVALID_LENGTH", "CHECKSUM_MISMATCH"


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1)
    return c


TABLE = _table()


def crc32c(chunks: list[bytes]) -> np.ndarray:
    """Checksums of many byte strings, byte by byte over all that are still that long."""
    size = np.array([len(x) for x in chunks], np.int64)
    data = np.frombuffer(b"".join(chunks), np.uint8)
    begin = np.cumsum(size) - size
    c = np.full(len(chunks), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    running = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), side="right")
    for at, n in enumerate(running.tolist()):
        i = order[:n]
        c[i] = TABLE[(c[i] ^ data[begin[i] + at]) & 0xFF] ^ (c[i] >> 8)
    return c ^ np.uint32(0xFFFFFFFF)


def encode_value(seq: int, value: bytes | None) -> bytes:
    return struct.pack(">q?", seq, value is None) + (b"" if value is None else struct.pack(">i", len(value)) + value)


def encode_key(key) -> bytes:
    if isinstance(key, str):
        return key.encode().replace(b"\0", b"\0\xff") + b"\0\0"
    return (key + (1 << 31)).to_bytes(4, "big")


def frame(records: list[tuple[object, int, bytes | None]], tag: int | None = None) -> bytes:
    """(key, seq, value or None) to the bytes of a log; tags are running maxima of seq, from `tag` on."""
    bodies = []
    for key, seq, value in records:
        tag = seq if tag is None else max(tag, seq)
        payload = encode_key(key) + encode_value(seq, value)
        bodies.append(struct.pack(">qi", tag, len(payload)) + payload)
    return b"".join(MAGIC + struct.pack(">I", int(c)) + b for c, b in zip(crc32c(bodies), bodies, strict=True))


@dataclass
class Replay:
    """The good records, why replay stopped and where, and the last good record's tag."""

    records: list[tuple[object, int, bytes | None]]
    reason: str
    offset: int
    tag: int | None = None


def _decode(payload: bytes, strings: bool) -> tuple[object, int, bytes | None]:
    if strings:
        end = 0
        while payload[end : end + 2] != b"\0\0":
            end += 2 if payload[end : end + 1] == b"\0" else 1
        key: object = payload[:end].replace(b"\0\xff", b"\0").decode()
        at = end + 2
    else:
        key, at = int.from_bytes(payload[:4], "big") - (1 << 31), 4
    seq, dead = struct.unpack_from(">q?", payload, at)
    if dead:
        return key, seq, None
    (n,) = struct.unpack_from(">i", payload, at + 9)
    return key, seq, payload[at + 13 : at + 13 + n]


def replay(raw: bytes, strings: bool = False, last: int | None = None) -> Replay:
    """Checks, for each record in turn: whole head, magic, tag (not under `last`, the tag before it), length, whole payload, checksum."""
    at, spans, reason = 0, [], CLEAN
    while at < len(raw):
        if at + HEAD.size > len(raw):
            reason = TRUNCATED
            break
        magic, crc, tag, n = HEAD.unpack_from(raw, at)
        if magic != MAGIC:
            reason = BAD_MAGIC
        elif last is not None and tag < last:
            reason = STALE
        elif n <= 0:
            reason = LENGTH
        elif at + HEAD.size + n > len(raw):
            reason = TRUNCATED
        if reason != CLEAN:
            break
        spans.append((at, n, crc, tag))
        last, at = tag, at + HEAD.size + n
    # heads tell where records end; the checksums of all of them follow at once
    good = crc32c([raw[a + 8 : a + HEAD.size + n] for a, n, *_ in spans]) == np.array([c for _, _, c, _ in spans], np.uint32) if spans else np.ones(0, bool)
    bad = np.flatnonzero(~good)
    if len(bad):
        at, reason, spans = spans[bad[0]][0], CHECKSUM, spans[: bad[0]]
    return Replay([_decode(raw[a + HEAD.size : a + HEAD.size + n], strings) for a, n, *_ in spans], reason, at, spans[-1][3] if spans else None)


def logs(batch: pa.RecordBatch):
    """(path, content) of a batch of logs, one log's bytes at a time."""
    for name, raw in zip(batch.column("path"), batch.column("content"), strict=True):
        yield name.as_py(), raw.as_py()


def some(files, size: int = 4 << 20):
    """Batches of logs (path, content) that are closed by the log with which they reach size."""
    held, total = [], 0
    for name, raw in files:
        held.append((name, raw))
        total += len(raw)
        if total >= size:
            yield _batch(held)
            held, total = [], 0
    if held:
        yield _batch(held)


def _batch(files) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n for n, _ in files], pa.string()), pa.array([raw for _, raw in files], pa.binary())], ["path", "content"])


def _bounded(files: DataFrame) -> None:
    """Batches of logs that come to a Python worker hold some 8 MB, not 10,000 logs; a longer log is a batch of its own."""
    ship(files.sparkSession)
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def decoded(files: DataFrame, key: T.DataType | None = None) -> DataFrame:
    """(file, key, seq, tombstone, value, reason, offset): the records of logs (path, content); reason and offset are the
    log's, and a log without a good record gives one row of nulls with them."""
    _bounded(files)
    kind = key or T.IntegerType()
    strings = isinstance(kind, T.StringType)
    arrow = pa.string() if strings else pa.int32()
    schema = pa.schema([("file", pa.string()), ("key", arrow), ("seq", pa.int64()), ("tombstone", pa.bool_()), ("value", pa.binary()), ("reason", pa.string()), ("offset", pa.int64())])

    def run(batches):
        for batch in batches:
            for name, raw in logs(batch):
                got = replay(raw, strings)
                rows = [(k, s, v is None, v) for k, s, v in got.records] or [(None, None, None, None)]
                for i in range(0, len(rows), 10_000):
                    part = rows[i : i + 10_000]
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (name, *r, got.reason, got.offset), strict=True)) for r in part], schema)

    return files.select("path", "content").mapInArrow(run, f"file string, key {kind.simpleString()}, seq long, tombstone boolean, value binary, reason string, offset long")


def truncated(files: DataFrame, key: T.DataType | None = None) -> DataFrame:
    """(path, content): logs cut where their replay stops, so that the next one ends clean."""
    _bounded(files)
    strings = isinstance(key, T.StringType)

    def run(batches):
        for batch in batches:
            yield from some((name, raw[: replay(raw, strings).offset]) for name, raw in logs(batch))

    return files.select("path", "content").mapInArrow(run, "path string, content binary")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_wal(spark: SparkSession, path: str, key: T.DataType | None = None) -> DataFrame:
    """decoded() of all log files under path."""
    return decoded(_files(spark, path), key)


def truncate_logs(spark: SparkSession, path: str, key: T.DataType | None = None) -> list[str]:
    """Cuts every damaged log file under path where its replay stops; returns their paths.

    The files are read by tasks; the driver gets one row for each damaged file and replaces it by its good prefix in one rename.
    """
    from tidemark.sources.manifest import Files

    files = Files(spark)
    damaged = read_wal(spark, path, key).where(F.col("reason") != CLEAN).select("file", "offset").distinct().collect()  # a row per damaged file
    for r in damaged:
        files.replace(r.file, files.read_bytes(r.file, r.offset))
    return sorted(r.file for r in damaged)


class Log:
    """A log on a shared file system: a folder of numbered files. Each append is one file, synced before the rename that makes it part of the log.

    Meant for the records since the last flush, which the driver holds; read_wal() reads logs of any number of files in tasks.
    """

    def __init__(self, spark: SparkSession, root: str, strings: bool = False):
        from tidemark.sources.manifest import Files

        self.files, self.root, self.strings = Files(spark), root.rstrip("/"), strings
        self.tag = self.replay().tag

    def paths(self) -> list[str]:
        return [f"{self.root}/{n}" for n in sorted(x for x in self.files.names(self.root) if x.startswith("wal-") and x.endswith(".log"))]

    def append(self, records: list[tuple[object, int, bytes | None]]) -> str:
        """Adds (key, seq, value or None) records; they are durable once it returns."""
        raw = frame(records, self.tag)
        have = self.paths()
        number = int(have[-1].rsplit("-", 1)[1][:-4]) + 1 if have else 0
        temporary = f"{self.root}/.tmp-{uuid.uuid4().hex}"
        self.files.write(temporary, raw)
        while not self.files.rename_new(temporary, path := f"{self.root}/wal-{number:012d}.log"):
            number += 1
        self.tag = max([s for _, s, _ in records] + ([self.tag] if self.tag is not None else []), default=None)
        return path

    def replay(self) -> Replay:
        """All files in order up to the first record that isn't good; offset is within the file where that stands."""
        records, tag, got = [], None, Replay([], CLEAN, 0)
        for path in self.paths():
            got = replay(self.files.read_bytes(path), self.strings, tag)
            records += got.records
            tag = got.tag if got.tag is not None else tag
            if got.reason != CLEAN:
                break
        return Replay(records, got.reason, got.offset, tag)

    def recover(self) -> Replay:
        """replay(), then cuts the file where it stopped and drops the files after it: the next replay gives the same records and ends clean."""
        tag, stopped, out = None, None, self.replay()
        if out.reason != CLEAN:
            for path in self.paths():
                if stopped is not None:
                    self.files.delete(path)
                    continue
                got = replay(raw := self.files.read_bytes(path), self.strings, tag)
                tag = got.tag if got.tag is not None else tag
                if got.reason != CLEAN:
                    stopped = path
                    self.files.replace(path, raw[: got.offset])
        self.tag = out.tag
        return out

    def reset(self) -> None:
        """Drops all records, after a flush has made them durable elsewhere; tags go on from the last."""
        for path in self.paths():
            self.files.delete(path)


def recovered(log: DataFrame) -> DataFrame:
    """The records of read_wal() as a change log."""
    return log.where(F.col("seq").isNotNull()).select("key", "seq", "tombstone", "value")
