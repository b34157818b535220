"""Merging segments: latest version per key, which tombstones a compaction must keep, and where its output files are cut."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.latest import latest
from tidemark.session import ship


def merge_drop_all(inputs: DataFrame, **names) -> DataFrame:
    """For reads, or where nothing older exists: no tombstone survives."""
    return latest(inputs, **names).where("not tombstone")


def merge_retain(inputs: DataFrame, candidates: DataFrame, key: str = "key") -> DataFrame:
    """For compaction: a tombstone stays only if a segment outside the merge still holds its key.

    candidates: rows of those segments. A semi join on the tombstones alone: live rows don't take part in it.
    """
    merged = latest(inputs, key=key)
    dead = merged.where("tombstone").join(candidates.select(key).distinct(), key, "left_semi")
    return merged.where("not tombstone").unionByName(dead.select(*merged.columns))


def cuts(sizes: np.ndarray, held: int, target: int) -> tuple[np.ndarray, int, int]:
    """The files, counted from 0, of rows that come in order, `held` bytes being in the open file; then the open file's number and bytes.

    A file is closed by the row with which it reaches target; the next row begins a new one at zero bytes.
    """
    ends, n = np.cumsum(sizes) + held, len(sizes)
    file, at, base, number = np.zeros(n, np.int64), 0, 0, 0
    while at < n and (last := int(np.searchsorted(ends, base + target))) < n:
        file[at : last + 1] = number
        at, base, number = last + 1, int(ends[last]), number + 1
    file[at:] = number
    return file, number, (int(ends[-1]) - base if n else held)


def _numbered(size: str, target: int):
    def run(batches):
        part, held, number = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            file, more, held = cuts(batch.column(batch.schema.get_field_index(size)).to_numpy(zero_copy_only=False), held, target)
            file, number = file + number, number + more
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(file.astype(np.int32))], [*batch.schema.names, "part", "file"])

    return run


def level_split(rows: DataFrame, size: str, target: int, key: str = "key", ranges: int | None = None, seen: Observation | None = None) -> DataFrame:
    """rows in key order with `part` and `file`: files hold consecutive keys, and each is closed by the row with which it reaches target.

    The rows are dealt into key ranges by one shuffle and stream through one task a range, which numbers its own files from 0:
    (part, file) names a file. Each range begins a file of its own, so at most one file a range falls short of the target; with one range
    the cuts are those of a single sequential merge. Nothing is joined, and no task sees all keys. seen gets `n`, the number of rows dealt.
    """
    ship(rows.sparkSession)
    dealt = (rows.repartitionByRange(ranges, key) if ranges else rows.repartitionByRange(key)).sortWithinPartitions(key)
    dealt = dealt.observe(seen, F.count(F.lit(1)).alias("n")) if seen is not None else dealt
    return dealt.mapInArrow(_numbered(size, target), T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("file", T.IntegerType())]))


def exact_split(rows: DataFrame, size: str, target: int, key: str = "key") -> DataFrame:
    """(key, file) as one sequential merge cuts it, files counted from 0 over the whole table.

    Each cut depends on all before it, so keys and sizes alone, not the rows, stream through one task in order: a few bytes a row. For
    the output of one merge; level_split() is what the store writes by.
    """
    return level_split(rows.select(key, F.col(size).cast("long").alias(size)), size, target, key, ranges=1).select(key, "file")
