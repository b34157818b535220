import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import codec

INTS = [-1, 0, 1, -245, 10023, -(1 << 31), (1 << 31) - 1] + random.Random(1234).sample(range(-(1 << 31), 1 << 31), 500)
STRINGS = ["", "a", "ab", "abc", "abd", "b", "foo\0bar", "\0", "\0\0", "é", "😀", "a\0"] + [
    "".join(chr(random.Random(i).choice([0, 65, 97, 98, 127])) for _ in range(i % 8)) for i in range(200)
]


def both(spark, values, kind, encode, decode=None):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("k", kind)]))
    cols = [F.col("k"), encode(F.col("k")).alias("e")]
    cols.append(decode(encode(F.col("k"))).alias("d") if decode else F.col("k").alias("d"))
    return [(r.k, bytes(r.e), r.d) for r in df.select(*cols).collect()]


def test_int_keys(spark):
    rows = both(spark, INTS, T.IntegerType(), codec.encode_int, codec.decode_int)
    assert all(len(e) == 4 and d == k for k, e, d in rows)
    assert [k for k, *_ in sorted(rows, key=lambda r: r[1])] == sorted(INTS)
    assert dict((k, e.hex()) for k, e, _ in rows)[-245] == "7fffff0b"


def test_long_keys(spark):
    values = [-(1 << 63), -1, 0, 1, (1 << 63) - 1, 12345678901]
    rows = both(spark, values, T.LongType(), codec.encode_long)
    assert [k for k, *_ in sorted(rows, key=lambda r: r[1])] == sorted(values)


def test_string_keys(spark):
    values = list(dict.fromkeys(STRINGS))
    rows = both(spark, values, T.StringType(), codec.encode_string, codec.decode_string)
    assert all(d == k for k, _, d in rows)
    assert [k for k, *_ in sorted(rows, key=lambda r: r[1])] == sorted(values, key=lambda s: s.encode())
    assert dict((k, e.hex()) for k, e, _ in rows)["foo\0bar"] == "666f6f00ff6261720000"


@pytest.mark.parametrize("kind,value,size", [(T.IntegerType(), 7, 18), (T.StringType(), "foo\0bar", 24), (T.LongType(), 7, 22)])
def test_record_size(spark, kind, value, size):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("k", kind)]))
    live = codec.record_size(F.col("k"), kind, F.lit(False), F.lit(1))
    dead = codec.record_size(F.col("k"), kind, F.lit(True), F.lit(0))
    assert tuple(df.select(live, dead).first()) == (size, size - 5)
