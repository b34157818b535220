"""WARC archives: written by DataFrame functions, read by a Python data source.

Writing: each page is one record, put together as text by column functions and written by Spark's text writer with the
record separator as its line separator: any Hadoop file system, task commits, no Python. Of pages with equal
payloads (by length and SHA-1) that of the least page_id becomes a response, the others revisit records without payload.

Reading, format "warc": partitions are planned from a listing on the driver, several small files or one large file each. A task
reads the headers of a record first. Equality, IN and null predicates on record_type, record_id, target_uri, payload_digest
and refers_to are pushed down and decided on the headers alone; payloads of records that fail, and all payloads under
option payload=false, are skipped by a seek (in .gz files by reading on) and never decoded; a skip beyond the file's end is an
error as a short read is. Memory is bounded by a header, the largest wanted payload and a batch of about `batch_bytes` of them. An archive is
read by one task: keep archives near a gigabyte, as write_warc() does by records.

Edges: null html is an empty payload; null url an empty URI; control characters and blanks in a URI are percent-coded. Of
rows that repeat both the least page_id and the payload each is a response. A null page_id counts as larger than all
and is written as the word null. Very long payloads are written and read whole. Empty tables give no records. Other columns of pages are
ignored. A truncated last record raises an error, whether its payload is wanted or not.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull

from tidemark.llm.common import fresh_path, small, table, written
from tidemark.session import ship

NL = "\r\n"
REVISIT = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"
SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_bytes long, headers map<string,string>, payload binary"
PUSHED = ("record_type", "record_id", "target_uri", "payload_digest", "refers_to")


def base32_sha1(column) -> object:
    """Bare upper-case base32 of the SHA-1 of a binary column: five hex digits make four base32 digits."""
    digits = F.sha1(column)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", most: int = 500_000) -> DataFrame:
    """(value): the text of each page's record, without the separator after it."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    # the payload's bytes are read once for all that is told of them
    told = pages.select("page_id", "url", payload.alias("payload")).withColumn("bytes", F.octet_length("payload")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    repeats = told.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = small(written(repeats.select(F.col("digest").alias("r_digest"), F.col("bytes").alias("r_bytes"), "first"), "repeats"), most)
    told = told.join(repeats, (F.col("digest") == F.col("r_digest")) & (F.col("bytes") == F.col("r_bytes")), "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    uri = F.coalesce(F.col("url"), F.lit(""))
    for plain, coded in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        uri = F.replace(uri, F.lit(plain), F.lit(coded))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "), F.col("bytes").cast("string"), F.lit(NL + NL))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    return told.select(
        F.concat(
            F.lit(f"WARC/1.1{NL}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
            F.lit(f"{NL}WARC-Record-ID: "), urn("page_id"), F.lit(f"{NL}WARC-Date: {date}{NL}WARC-Target-URI: "), uri,
            F.lit(f"{NL}WARC-Payload-Digest: sha1:"), F.col("digest"),
            F.when(again, F.concat(F.lit(f"{NL}WARC-Profile: {REVISIT}{NL}WARC-Refers-To: "), urn("first"))).otherwise(""),
            F.lit(f"{NL}Content-Type: application/http; msgtype=response{NL}Content-Length: "),
            (F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))).cast("string"),
            F.lit(NL + NL), http, F.when(again, "").otherwise(F.col("payload")),
        ).alias("value")
    )


def write_warc(pages: DataFrame, path: str, per_file: int = 10_000) -> None:
    """Writes pages (page_id, url, html) as WARC files of at most per_file records under path."""
    records(pages).write.option("lineSep", NL + NL).option("maxRecordsPerFile", per_file).text(path)


@dataclass
class Files(InputPartition):
    paths: list[str]


class _Bytes:
    """A file read forward in large blocks; skips by seeking where the file allows."""

    def __init__(self, path: str, block: int = 1 << 20):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.gz = path.endswith(".gz")
        self.file = system.open_input_stream(name, compression=None) if self.gz else system.open_input_file(name)
        self.size = None if self.gz else self.file.size()
        self.block, self.buffer, self.at = block, b"", 0
        self.inflater = zlib.decompressobj(31) if self.gz else None

    def _more(self) -> bool:
        raw = self.file.read(self.block)
        if self.gz:
            out = []
            while raw:
                out.append(self.inflater.decompress(raw))
                raw = self.inflater.unused_data
                if self.inflater.eof:
                    self.inflater = zlib.decompressobj(31)
                else:
                    break
            data = b"".join(out)
            if not data and out:
                return self._more()
        else:
            data = raw
        if not data:
            return False
        self.buffer, self.at = self.buffer[self.at :] + data, 0
        return True

    def upto(self, mark: bytes) -> bytes | None:
        """What stands before the mark, which is passed; None at the end of the file."""
        start = self.at
        while (i := self.buffer.find(mark, start)) < 0:
            back = len(self.buffer) - self.at
            if not self._more():
                if self.buffer[self.at :].strip():
                    raise ValueError("the file ends within a header")
                return None
            start = max(0, back - len(mark))
        out, self.at = self.buffer[self.at : i], i + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n:
            if not self._more():
                raise ValueError("the file ends within a record")
        out, self.at = self.buffer[self.at : self.at + n], self.at + n
        return out

    def skip(self, n: int) -> None:
        there = len(self.buffer) - self.at
        if n <= there:
            self.at += n
        elif self.gz:
            while n > len(self.buffer) - self.at:
                n -= len(self.buffer) - self.at
                self.at = len(self.buffer)
                if not self._more():
                    raise ValueError("the file ends within a record")
            self.at += n
        else:
            to = self.file.tell() + n - there
            if to > self.size:
                raise ValueError("the file ends within a record")
            self.buffer, self.at = b"", 0
            self.file.seek(to)


def _fields(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.batch_bytes = int(options.get("batch_bytes", 8 << 20))
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in PUSHED:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((name, "in", [f.value]))
            elif isinstance(f, In):
                self.tests.append((name, "in", list(f.value)))
            elif isinstance(f, IsNull):
                self.tests.append((name, "in", [None]))
            elif isinstance(f, IsNotNull):
                self.tests.append((name, "some", None))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(self.path) if ":" in self.path.split("/")[0] else (fs.LocalFileSystem(), self.path)
        prefix = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else ("file://" if isinstance(system, fs.LocalFileSystem) else self.path.split("://")[0] + "://")
        info = system.get_file_info(name)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._")
        plan, size = [], self.partition_bytes
        for path, n in files:
            if not plan or size + n > self.partition_bytes:
                plan.append(Files([]))
                size = 0
            plan[-1].paths.append(prefix + path)
            size += n
        return plan

    def read(self, partition):
        if partition is None:
            return
        rows, held = [], 0
        for path in partition.paths:
            source = _Bytes(path)
            while (head := source.upto(b"\r\n\r\n")) is not None:
                if not head.strip():
                    continue
                if not head.lstrip().startswith(b"WARC/"):
                    raise ValueError(f"no record begins where one should in {path}")
                h = _fields(head.lstrip())
                length = int(h.get("content-length", 0))
                row = {
                    "record_type": h.get("warc-type"), "record_id": _bare(h.get("warc-record-id")), "target_uri": h.get("warc-target-uri"), "warc_date": h.get("warc-date"),
                    "payload_digest": (h.get("warc-payload-digest") or "").partition(":")[2] or None, "refers_to": _bare(h.get("warc-refers-to")),
                }
                if not all((row[n] in v) if kind == "in" else row[n] is not None for n, kind, v in self.tests):
                    source.skip(length)
                    source.upto(b"\r\n\r\n")
                    continue
                left = length
                row["payload_bytes"], row["payload"], row["headers"] = length, None, list(h.items())
                if h.get("content-type", "").startswith("application/http"):
                    http = source.upto(b"\r\n\r\n")
                    left -= len(http) + 4
                    row["payload_bytes"] = int(_fields(http).get("content-length", left))
                if self.payload:
                    row["payload"] = source.take(left) if row["record_type"] != "revisit" else None
                    left = 0 if row["record_type"] != "revisit" else left
                source.skip(left)
                source.upto(b"\r\n\r\n")
                rows.append(row)
                held += 512 + len(row["payload"] or b"")
                if held >= self.batch_bytes:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "warc_date", "payload_digest", "refers_to")]
    + [("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, ARROW)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records under path; predicates on the columns of PUSHED are decided on headers."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    found = read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.expr(f"try_cast(substring({c}, {len(URN) + 1}) as bigint)")
    # of responses both are told by the bytes read back; a revisit has none, so that its headers tell
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes"))
    digest = F.coalesce(base32_sha1(F.col("payload")), F.col("payload_digest"))
    return found.select(page("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


OP6_SQL = r"""
WITH told AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
named AS (
  SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first,
         list_transform(range(0, 8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::BIGINT) AS g FROM told)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((g[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
FROM named
"""
