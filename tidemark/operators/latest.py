"""Latest-version-wins reads over a change log, as lazy DataFrames.

The merge is a partial aggregate: each task keeps one version per key before the shuffle, so a key with a third of all
versions costs no more than any other. Tombstones are dropped after the merge, never before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import running


def latest(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """One row per key: its version of greatest seq, tombstones included."""
    rest = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("__best"))
    return best.select(key, *[F.col(f"__best.{c}").alias(c) for c in rest]).select(*log.columns)


def live(log: DataFrame, key: str = "key", seq: str = "seq", tombstone: str = "tombstone") -> DataFrame:
    """The present state: latest versions that aren't tombstones."""
    return latest(log, key, seq).where(~F.col(tombstone))


def between(log: DataFrame, low, high, key: str = "key") -> DataFrame:
    """Versions with low <= key <= high; either bound may be None. The filter reaches the Parquet scan."""
    test: Column = F.lit(True)
    if low is not None:
        test = F.col(key) >= F.lit(low)
    if high is not None:
        test = test & (F.col(key) <= F.lit(high)) if low is not None else F.col(key) <= F.lit(high)
    return log.where(test)


def scan(log: DataFrame, low=None, high=None, limit: int | None = None, **names) -> DataFrame:
    """Live rows in key order; both bounds inclusive; low > high gives none."""
    rows = live(between(log, low, high, names.get("key", "key")), **names).orderBy(names.get("key", "key"))
    return rows if limit is None else rows.limit(limit)


def get(log: DataFrame, wanted, **names) -> DataFrame:
    """The live row of one key: at most one row, none if the key is absent or deleted."""
    return live(log.where(F.col(names.get("key", "key")) == F.lit(wanted)), **names)


def multi_get(log: DataFrame, probes: DataFrame, key: str = "key", seq: str = "seq", tombstone: str = "tombstone") -> DataFrame:
    """Each probed key with its live values, nulls where there is none. Versions of keys not asked for are dropped before the merge."""
    asked = log.join(probes.select(key).distinct(), key, "left_semi")
    return probes.join(live(asked, key, seq, tombstone), key, "left")


def as_of(log: DataFrame, at: int, seq: str = "seq") -> DataFrame:
    """The log as it was when seq `at` was the last."""
    return log.where(F.col(seq) <= F.lit(at))


def floor_key(keys: DataFrame, probes: DataFrame, key: str = "key", probe: str = "probe") -> DataFrame:
    """(probe, floor): the greatest key <= probe, or null. One sort over both sides, no range join."""
    return _neighbour(keys, probes, key, probe, True).withColumnRenamed("found", "floor")


def ceiling_key(keys: DataFrame, probes: DataFrame, key: str = "key", probe: str = "probe") -> DataFrame:
    """(probe, ceiling): the least key >= probe, or null."""
    return _neighbour(keys, probes, key, probe, False).withColumnRenamed("found", "ceiling")


def _neighbour(keys: DataFrame, probes: DataFrame, key: str, probe: str, down: bool) -> DataFrame:
    """The greatest key up to each probe, or the least from it on: a running maximum or minimum over keys and probes in one order."""
    k = keys.select(F.col(key).alias("x"), F.lit(0 if down else 1).alias("side"), F.col(key).alias("key")).distinct()
    p = probes.select(F.col(probe).cast(k.schema["x"].dataType).alias("x"), F.lit(1 if down else 0).alias("side"), F.lit(None).cast(k.schema["key"].dataType).alias("key"))
    asked = 1 if down else 0
    run = running(k.unionByName(p), ["x", "side"], F.col("key"), F.max if down else F.min, "found", back=not down)
    return run.where(F.col("side") == asked).select(F.col("x").alias(probe), "found")


def version_diff(log: DataFrame, before: int, after: int, key: str = "key", seq: str = "seq", tombstone: str = "tombstone", value: str = "value") -> DataFrame:
    """(key, change, old, new) of keys whose live value differs between two moments: added, removed or changed."""
    old = live(as_of(log, before, seq), key, seq, tombstone).select(key, F.col(value).alias("old"), F.lit(True).alias("had"))
    new = live(as_of(log, after, seq), key, seq, tombstone).select(key, F.col(value).alias("new"), F.lit(True).alias("has"))
    kind = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").otherwise("changed")
    both = old.join(new, key, "full").where(F.col("had").isNull() | F.col("has").isNull() | ~F.col("old").eqNullSafe(F.col("new")))
    return both.select(key, kind.alias("change"), "old", "new")


def shadowed_versions(log: DataFrame, key: str = "key") -> DataFrame:
    """(key, shadowed): versions of each key that a later one hides."""
    return log.groupBy(key).agg((F.count("*") - 1).alias("shadowed"))
