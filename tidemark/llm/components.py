"""Connected components by alternating large-star and small-star.

Nodes are longs; edges never leave the cluster. Each round writes its edges to the shared folder, so lineage stays
short and a lost executor costs one round at most. A node of very high degree is handled by a pre-aggregated minimum
and a join, whose large partitions adaptive execution splits: no neighbourhood is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.llm.common import drop_written, written


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least node of its neighbourhood."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    # (u, v) with v > u is e itself, kept as u < v
    return e.join(least, "u").select(F.col("m").alias("u"), "v")


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these; e holds (u, v) with u < v."""
    least = e.groupBy("v").agg(F.min("u").alias("m"))
    moved = e.join(least, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.union(least.select(F.col("m").alias("u"), "v")).distinct()


def _written_state(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges and their number and hash sum, observed while they are written."""
    seen = Observation()
    e = written(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")), "edges")
    return e, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that an edge (u, v) names; root is the least node of its component.

    Loops and repeated edges are ignored, null ends too. An empty table gives an empty result. Raises if
    `most_rounds` rounds don't settle it (the number needed grows with the logarithm of the longest path).
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e, before = _written_state(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    for _ in range(most_rounds if before[0] else 0):
        after, now = _written_state(_small_star(_large_star(e)))
        drop_written(e)
        e = after
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
