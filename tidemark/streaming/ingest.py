"""Structured Streaming into a store, and the latest state of a stream.

Versions are ordered by the store's sequence numbers, so late rows need no watermark: within a micro-batch `order` decides, and a
batch that is replayed after a failure is recognised by its id and written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.plans.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, name: str = "ingest", once: bool = True) -> StreamingQuery:
    """stream: (key, tombstone, value[, order]). Each micro-batch is one committed batch of the store."""

    def write(rows: DataFrame, batch: int) -> None:
        store.apply_batch(rows, batch_id=f"{name}-{batch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_stream(stream: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The latest version per key of an unbounded log, for update or complete mode: state is one row per key."""
    from pyspark.sql import functions as F

    rest = [c for c in stream.columns if c != key]
    best = stream.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("best"))
    return best.select(key, *[F.col(f"best.{c}").alias(c) for c in rest])
