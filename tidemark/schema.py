"""The record: key, seq, tombstone, value. A log holds any number of versions of a key; seq orders them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_TYPES = (T.IntegerType, T.LongType, T.StringType)


def record_schema(key: T.DataType) -> T.StructType:
    if not isinstance(key, KEY_TYPES):
        raise TypeError(f"keys are int, bigint or string, not {key.simpleString()}")
    return T.StructType([
        T.StructField("key", key, False), T.StructField("seq", T.LongType(), False),
        T.StructField("tombstone", T.BooleanType(), False), T.StructField("value", T.BinaryType(), True),
    ])


def checked(df: DataFrame) -> DataFrame:
    """Fails while running, not before, on a null key or a value that is null without a tombstone or set with one."""
    bad = F.col("key").isNull() | (F.col("tombstone") != F.col("value").isNull())
    message = F.raise_error(F.lit("a record needs a key, and a value exactly if it is no tombstone"))
    return df.withColumn("key", F.when(F.coalesce(bad, F.lit(True)), message.cast(df.schema["key"].dataType)).otherwise(F.col("key")))
