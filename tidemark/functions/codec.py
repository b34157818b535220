"""Order-preserving key encodings and the byte sizes that thresholds count, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a record beside its key (sequence number, flag) and of a payload's length.
VALUE_HEAD, LENGTH_HEAD, FILE_HEAD, LOG_HEAD = 9, 4, 16, 20


def encode_int(key: Column) -> Column:
    """Four big-endian bytes with the sign bit turned, so that bytes order as ints do."""
    return F.unhex(F.lpad(F.hex(key.cast("long") + F.lit(1 << 31)), 8, "0"))


def decode_int(raw: Column) -> Column:
    return (F.conv(F.hex(raw), 16, 10).cast("long") - F.lit(1 << 31)).cast("int")


def encode_long(key: Column) -> Column:
    """Eight big-endian bytes with the sign bit turned."""
    return F.unhex(F.lpad(F.hex(key.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def encode_string(key: Column) -> Column:
    """UTF-8 with each NUL as 00 FF and 00 00 at the end: a prefix sorts before what it begins."""
    return F.unhex(F.concat(F.array_join(F.transform(F.split(key, "\0", -1), lambda p: F.hex(F.encode(p, "UTF-8"))), "00FF"), F.lit("0000")))


def decode_string(raw: Column) -> Column:
    """Text up to 00 00; a NUL for each 00 FF. Works on hex pairs, so that no pair is cut."""
    pairs = F.regexp_replace(F.hex(raw), "(..)", "$1 ")
    body = F.regexp_replace(pairs, "^((?:(?!00 00 ).. |00 FF )*?)00 00 .*$", "$1")
    return F.decode(F.unhex(F.replace(F.replace(body, F.lit("00 FF "), F.lit("00 ")), F.lit(" "), F.lit(""))), "UTF-8")


def encode(key: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.IntegerType):
        return encode_int(key)
    return encode_long(key) if isinstance(kind, T.LongType) else encode_string(key)


def key_size(key: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.IntegerType):
        return F.lit(4)
    if isinstance(kind, T.LongType):
        return F.lit(8)
    return F.octet_length(key) + (F.length(key) - F.length(F.replace(key, F.lit("\0"), F.lit("")))) + 2


def value_size(tombstone: Column, payload_bytes: Column) -> Column:
    return F.lit(VALUE_HEAD) + F.when(tombstone, 0).otherwise(payload_bytes + LENGTH_HEAD)


def record_size(key: Column, kind: T.DataType, tombstone: Column, payload_bytes: Column) -> Column:
    return (key_size(key, kind) + value_size(tombstone, payload_bytes)).cast("long")
