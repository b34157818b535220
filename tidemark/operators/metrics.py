"""Amplification figures and latency summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.latest import live
from tidemark.operators.running import holding, ranked
from tidemark.sources.manifest import Version


def read_amplification(segments: DataFrame, probes: DataFrame, probe: str = "key") -> DataFrame:
    """(probe, consulted): how many segments' key ranges hold each probed key. segments: (min_key, max_key), a manifest's rows.

    Bounds and probes are sorted together and ranges counted as they open and close: no range join, however many segments there are.
    """
    return holding(segments, probes, "min_key", "max_key", probe).withColumnRenamed("n", "consulted")


def write_amplification(v: Version) -> float:
    """Bytes written to segments and tail per byte put."""
    return v.written_bytes / v.put_bytes if v.put_bytes else 0.0


def space_amplification(log: DataFrame, **names) -> float:
    """Stored versions per live one."""
    n, m = log.count(), live(log, **names).count()
    return n / m if m else float(n > 0)


def latencies(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, avg, p50, p99, max): latency_summary()'s figures for each group of a table of times, by place in one distributed order.

    Null times are left out. A group with a third of all rows is dealt over as many ranges as its rows need.
    """
    rows = rows.select(group, value).where(F.col(value).isNotNull())
    placed = ranked(rows, [group, value])
    told = rows.groupBy(group).agg(F.avg(value).alias("avg"), F.max(value).alias("max"), F.count("*").alias("n"))
    first = placed.groupBy(group).agg(F.min("place").alias("first")).withColumnRenamed(group, "__g")
    told = told.join(first, F.col(group).eqNullSafe(F.col("__g"))).select(F.col(group).alias("__g"), "avg", "max", "n", "first")
    at = F.col("place") - F.col("first")  # from 0 in its group
    half, most = F.floor(F.col("n") / 2), F.least(F.col("n") - 1, F.floor(F.col("n") * 0.99))
    picked = placed.join(told, placed[group].eqNullSafe(told["__g"])).where((at == half) | (at == most))
    return picked.groupBy(group).agg(
        F.first("avg").alias("avg"), F.max(F.when(at == half, F.col(value))).alias("p50"), F.max(F.when(at == most, F.col(value))).alias("p99"), F.first("max").alias("max")
    )


def latency_summary(times: list[float]) -> dict[str, float]:
    """Mean, median, 99th percentile (by place in the sorted list), maximum and operations a second of times in seconds."""
    a = sorted(times)
    n = len(a)
    if not n:
        return {"avg": 0.0, "p50": 0.0, "p99": 0.0, "max": 0.0, "ops": 0.0}
    return {"avg": sum(a) / n, "p50": a[n // 2], "p99": a[min(n - 1, int(n * 0.99))], "max": a[-1], "ops": n / sum(a) if sum(a) else 0.0}
