"""Workloads: Zipfian keys, a seeded shuffle, and batches of the six standard mixes of operations."""

from __future__ import annotations

import numpy as np

#: Shares of reads, updates, inserts, scans and read-modify-writes of each mix.
MIXES = {
    "A": {"read": 0.5, "update": 0.5},
    "B": {"read": 0.95, "update": 0.05},
    "C": {"read": 1.0},
    "D": {"read": 0.95, "insert": 0.05},
    "E": {"scan": 0.95, "insert": 0.05},
    "F": {"read": 0.5, "rmw": 0.5},
}


def splitmix64(seed: int, n: int) -> np.ndarray:
    """The first n values of the generator from a seed, all at once."""
    return splitmix64_at(seed, np.arange(1, n + 1, dtype=np.uint64))


def splitmix64_at(seed: int, places: np.ndarray) -> np.ndarray:
    """The values at places, counted from 1: the state is seed plus multiples of a constant, so no value needs those before it."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shuffled(n: int, seed: int) -> np.ndarray:
    """0..n-1 in an order that the seed fixes."""
    return np.argsort(splitmix64(seed, n), kind="stable")


def zipf(n: int, count: int, theta: float = 0.99, seed: int = 42) -> np.ndarray:
    """count ranks below n, rank r drawn in proportion to (r + 1) ** -theta, by inverting the exact cumulative sum."""
    cumulative = np.cumsum(np.arange(1, n + 1, dtype=float) ** -theta)
    u = splitmix64(seed, count) / 2.0**64
    return np.searchsorted(cumulative, u * cumulative[-1], side="right").clip(0, n - 1)


def operations(mix: str, keys: int, count: int, seed: int = 42, longest_scan: int = 100):
    """Arrays (kind, key, length) of one mix; inserts take new keys, mix D reads the newest."""
    shares = MIXES[mix]
    u = splitmix64(seed + 1, count) / 2.0**64
    kinds = np.array(list(shares))[np.searchsorted(np.cumsum(list(shares.values())), u, side="right").clip(0, len(shares) - 1)]
    key = zipf(keys, count, seed=seed)
    insert = kinds == "insert"
    newest = keys + np.cumsum(insert)
    key = np.where(insert, newest - 1, newest - 1 - key if mix == "D" else key)
    length = np.where(kinds == "scan", 1 + splitmix64(seed + 2, count) % np.uint64(longest_scan), 0).astype(np.int64)
    return kinds, key, length


def key_order(spark, n: int, seed: int = 42):
    """(id, value, key): the ids 0..n-1 with their generator values, by which a shuffled load is ordered, and their text keys; made in tasks."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tidemark.session import ship

    ship(spark)

    def run(batches):
        for b in batches:
            z = splitmix64_at(seed, b.column("id").to_numpy() + 1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(z.view(np.int64))], ["id", "value"])

    return spark.range(n).mapInArrow(run, "id long, value long").withColumn("key", F.format_string("user%012d", "id"))


def user_key(i: int) -> str:
    return f"user{i:012d}"
