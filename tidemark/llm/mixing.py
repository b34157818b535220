"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

The level: a source's target is min(cap, level * weight), the targets adding up to the budget. Sources are put in order of
cap / weight; a source is clamped if, with all before it clamped, the level would lift it over its cap. This is where
clamping and resharing the excess until nothing is above its cap ends, in one pass over one row per source.

The sample: a source's target in words is so many whole repetitions of all its documents and a rest. The rest is
filled with documents in order of a seeded MD5 of their ids, the last one in part, so each source's words come to
its target rounded down. Documents are first summed by the leading digits of that hash (pre-aggregated, so a hot
source is no burden); whole buckets lie under or over the rest, and only the one bucket per source that the rest
ends in is put in order, about 1 / 4096 of the source.

Edges: null texts have size 0, null sources are one source that comes last, an empty table gives no rows. Very long texts
are counted whole. Rows that repeat an id are taken one after the other, longer ones first. Other columns pass through in mixed(); columns that
clash with the added ones (size, source_size, target, taken) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written
from tidemark.operators.running import running

EPOCHS = 3
DIGITS = 3
ADDED = ["size", "source_size", "target", "taken"]


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """docs with its size in words and its place in the seeded order."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    place = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return docs.withColumn("size", size).withColumn("__place", place).withColumn("__bucket", F.substring("__place", 1, DIGITS))


def _targets(sources: DataFrame, weights: list[int], epochs: int) -> DataFrame:
    """(source, source_size) to (source, source_size, target): water-filling over one row per source."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * epochs)
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("w").over(every))
    s = s.withColumn("spare", F.col("total") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
    s = s.withColumn("rest", F.col("weights") - F.coalesce(F.sum("w").over(by_ratio), F.lit(0)))
    # all that stand before a source that isn't clamped are clamped, so the first such source tells the level
    s = s.withColumn("clamped", F.col("cap").cast("double") * F.col("rest") < F.col("w").cast("double") * F.col("spare"))
    first = Window.partitionBy().orderBy(F.col("rest").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("free", F.first(F.when(~F.col("clamped"), F.struct("spare", "rest")), ignorenulls=True).over(first))
    level = F.col("free.spare").cast("double") * F.col("w") / F.col("free.rest")
    return s.select("source", "source_size", F.when(F.col("clamped") | F.col("free").isNull(), F.col("cap").cast("double")).otherwise(level).alias("target"))


def _mixed(sized: DataFrame, weights: list[int], epochs: int) -> DataFrame:
    """sized, as _sized() gives it, with source_size, target and taken."""
    buckets = written(sized.groupBy("source", "__bucket").agg(F.sum("size").alias("n")), "buckets")
    sources = _targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), weights, epochs)
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as long) div source_size")).otherwise(F.lit(0)))
    sources = sources.withColumn("rest", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))
    sources = written(sources, "sources")  # a row for each source: joins choose broadcast by its true size
    # where in its source each bucket begins
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = placed.toDF("b_source", "b_bucket", "n", "begin").join(sources, F.col("b_source").eqNullSafe(F.col("source"))).where("begin <= rest and rest < begin + n")
    # the edge buckets are put in order together, source by source: base is what lies before a source's own
    earlier = Window.orderBy("b_source").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.select("b_source", "b_bucket", (F.col("rest") - F.col("begin")).alias("room"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    edge = written(edge.toDF("e_source", "edge", "room", "base"), "edge")
    levels = sources.join(edge, F.col("source").eqNullSafe(F.col("e_source")), "left").select(F.col("source").alias("l_source"), "source_size", "target", "whole", "rest", "edge", "room", "base")
    levels = written(levels, "levels")
    rows = sized.join(levels, sized.source.eqNullSafe(levels.l_source))
    inside = rows.where("__bucket = edge").withColumn("__shorter", -F.col("size")).withColumn("__row", F.monotonically_increasing_id())
    inside = running(inside, ["source", "__place", "__shorter", "__row"], F.col("size"), F.sum, "__run")
    inside = inside.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - (F.col("__run") - F.col("size") - F.col("base")))))
    outside = rows.where("__bucket <> edge or edge is null").withColumn("part", F.when((F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("__bucket") < F.col("edge"))), F.col("size")).otherwise(F.lit(0)))
    out = inside.drop("__shorter", "__row", "__run").unionByName(outside)
    return out.withColumn("taken", (F.col("whole") * F.col("size") + F.col("part")).cast("long"))


def mixed(docs: DataFrame, weights: list[int] = (1, 2, 3), epochs: int = EPOCHS, seed: int = 7) -> DataFrame:
    """docs with size, source_size, target (words, of its source) and taken (words, repeats counted)."""
    docs = docs.drop(*ADDED)
    return _mixed(_sized(docs, seed), list(weights), epochs).select(*docs.columns, *ADDED)


def mixed_sizes(docs: DataFrame, weights: list[int] = (1, 2, 3), epochs: int = EPOCHS, seed: int = 7) -> DataFrame:
    """mixed() without the texts, whose words are counted once: all else rests on a written table of ids, sources and sizes."""
    sized = written(_sized(docs.select("doc_id", "source", "text"), seed).drop("text"), "sized")
    return _mixed(sized, list(weights), epochs).select("doc_id", "source", *ADDED)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents")).select("doc_id", *ADDED)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of which words are taken, with how many."""
    return mixed(docs).where("taken > 0")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':7') AS place
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM sums),
filled AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT
           - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spare,
         (sum(w) OVER ())::BIGINT
           - coalesce(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest
  FROM weighed),
marked AS (SELECT *, cap::DOUBLE * rest < w::DOUBLE * spare AS clamped FROM filled),
free AS (SELECT spare, rest FROM marked WHERE NOT clamped ORDER BY rest DESC LIMIT 1),
targets AS (
  SELECT m.source, m.source_size,
         CASE WHEN m.clamped OR f.rest IS NULL THEN m.cap::DOUBLE ELSE f.spare::DOUBLE * m.w / f.rest END AS target
  FROM marked m LEFT JOIN free f ON true),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM targets),
run AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.whole, floor(t.target)::BIGINT - t.whole * t.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN split t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM run
"""
