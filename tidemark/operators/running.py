"""Running sums, maxima and ranks over a whole table's order, without one task that sees all rows.

The rows are dealt into ranges of the order once and written with their range's number, so that both what follows within a
range and what is summed by range rest on the same ranges (taking the number of a range from two copies of one exchange
is not safe: each copy samples and coalesces its ranges anew). What a range has before it comes from one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written


def running(rows: DataFrame, by: list[str], value: Column, fold, name: str = "run", back: bool = False) -> DataFrame:
    """rows with `name`: fold (F.sum, F.max or F.min, nulls ignored) of value over all rows up to each in order of `by`.

    back: from each row on instead. Rows that tie in all of `by` come in any order.
    """
    mine = written(rows.withColumn("__v", value).repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranges")
    # back: in falling order, as a frame that ends at the last row is folded anew for every row of it
    order = [F.desc(c) if back else F.asc(c) for c in by]
    before = Window.orderBy(F.desc("__part") if back else F.asc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    parts = mine.groupBy("__part").agg(fold("__v").alias("__sum")).select("__part", fold("__sum").over(before).alias("__carry"))
    local = mine.withColumn("__local", fold("__v").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    both = F.array("__local", "__carry")
    of = {F.sum: F.when(F.col("__local").isNull() & F.col("__carry").isNull(), F.lit(None)).otherwise(F.coalesce("__local", F.lit(0)) + F.coalesce("__carry", F.lit(0))), F.max: F.array_max(both), F.min: F.array_min(both)}[fold]
    return local.join(parts, "__part").withColumn(name, of).select(*rows.columns, name)  # by the true size of one row per range


def ranked(rows: DataFrame, by: list[str], name: str = "place") -> DataFrame:
    """rows with their place (from 1, long) in order of `by`."""
    return running(rows, by, F.lit(1).cast("long"), F.sum, name)


def counts_between(keys: DataFrame, ranges: DataFrame, key: str = "key") -> DataFrame:
    """(range_id, n): how many keys lie between low and high, bounds inclusive, for any number of ranges (range_id, low, high).

    One sort over keys and bounds together instead of a range join; repeated keys count each, ranges with low > high hold none.
    """
    k = keys.select(F.col(key).alias("x"), F.lit(1).alias("side"), F.lit(1).cast("long").alias("one"), F.lit(None).cast(ranges.schema["range_id"].dataType).alias("range_id"))
    zero = F.lit(0).cast("long")
    asked = ranges.where("low <= high")
    low = asked.select(F.col("low").cast(k.schema["x"].dataType).alias("x"), F.lit(0).alias("side"), zero.alias("one"), "range_id")
    high = asked.select(F.col("high").cast(k.schema["x"].dataType).alias("x"), F.lit(2).alias("side"), zero.alias("one"), "range_id")
    run = running(k.union(low).union(high), ["x", "side"], F.col("one"), F.sum)
    got = run.where("side <> 1").groupBy("range_id").agg(F.sum(F.when(F.col("side") == 2, F.col("run")).otherwise(-F.col("run"))).alias("n"))
    return ranges.select("range_id").join(got, "range_id", "left").select("range_id", F.coalesce("n", zero).alias("n"))


def holding(intervals: DataFrame, probes: DataFrame, low: str, high: str, probe: str) -> DataFrame:
    """(probe, n): how many intervals [low, high] hold each probe, repeated probes each; no join of intervals and probes."""
    kind, zero = probes.schema[probe].dataType, F.lit(0).cast("long")
    bounded = intervals.where(F.col(low) <= F.col(high))
    begin = bounded.select(F.col(low).cast(kind).alias("x"), F.lit(0).alias("side"), F.lit(1).cast("long").alias("one"))
    end = bounded.select(F.col(high).cast(kind).alias("x"), F.lit(2).alias("side"), F.lit(-1).cast("long").alias("one"))
    run = running(begin.union(end).union(probes.select(F.col(probe).alias("x"), F.lit(1).alias("side"), zero.alias("one"))), ["x", "side"], F.col("one"), F.sum)
    return run.where("side = 1").select(F.col("x").alias(probe), F.col("run").alias("n"))
