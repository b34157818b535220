"""What the operators share: guarded broadcasts, bounded batches, tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import fresh_path, ship, written

__all__ = ["bounded_batches", "crc_mod5", "drop_written", "empty", "fresh_path", "small", "table", "written"]


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by written() once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/tidemark/" in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it is proven to have at most `most` rows, else df as it is.

    Meant for written tables, whose count comes from the Parquet footers.
    """
    return F.broadcast(df) if df.count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod5(column) -> object:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def bounded_batches(spark: SparkSession, records: int = 1000, size: str = "8m") -> None:
    """Caps the Arrow batches that Python operators see, so that very long texts don't add up in a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
