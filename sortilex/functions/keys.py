"""Byte-string keys in shortlex order (length first, then unsigned bytes), as column expressions.

A table of entries has the columns ``key`` (binary), ``klen`` (its length, stored so that range predicates reach the
Parquet scan), ``ts`` (decimal(20,0), carried along, never compared) and ``value`` (binary).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_SCHEMA = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("klen", T.IntegerType()), T.StructField("ts", T.DecimalType(20, 0)), T.StructField("value", T.BinaryType())])


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def entries(df: DataFrame, key: Column | str, value: Column | str, ts: Column | str | None = None) -> DataFrame:
    """Any table as entries; numbers become their decimal text. A missing timestamp is 0."""
    k = _col(key).cast("string").cast("binary")
    stamp = F.lit(0) if ts is None else _col(ts)
    return df.select(k.alias("key"), F.octet_length(k).alias("klen"), stamp.cast("decimal(20,0)").alias("ts"), _col(value).cast("string").cast("binary").alias("value"))


def shortlex(key: Column | str = "key") -> tuple[Column, Column]:
    """The pair to order by."""
    return F.octet_length(_col(key)), _col(key)


def compare(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1."""
    a, b = _col(a), _col(b)
    la, lb = F.octet_length(a), F.octet_length(b)
    return F.when(la != lb, F.when(la < lb, -1).otherwise(1)).when(a == b, 0).when(a < b, -1).otherwise(1)


def size(key: Column | str) -> Column:
    return F.octet_length(_col(key))


def is_empty(key: Column | str) -> Column:
    return F.octet_length(_col(key)) == 0


def overlap(a: Column | str, b: Column | str) -> Column:
    """Length of the common prefix in bytes."""
    a, b = _col(a), _col(b)
    n = F.least(F.octet_length(a), F.octet_length(b))
    places = F.filter(F.sequence(F.lit(0), n), lambda i: i > 0)
    first = F.array_position(F.transform(places, lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), False)
    return F.when(first == 0, n).otherwise(first - 1).cast("int")


def splice(prefix_of: Column | str, length: Column | str, rest: Column | str) -> Column:
    """The first ``length`` bytes of one key, then another's bytes."""
    return F.concat(F.substring(_col(prefix_of), F.lit(1), _col(length)), _col(rest))


def rest_after(key: Column | str, length: Column | str) -> Column:
    """The bytes after the first ``length``."""
    return F.substring(_col(key), _col(length) + 1, F.octet_length(_col(key)))


def printable(key: Column | str) -> Column:
    """Bytes as characters, NUL as ``#``."""
    return F.replace(F.decode(_col(key), "ISO-8859-1"), F.char(F.lit(0)), F.lit("#"))


def checksum(data: Column | str) -> Column:
    """CRC-32 (the usual reflected polynomial) of bytes."""
    return F.crc32(_col(data))


def little_endian(number: Column | str, n_bytes: int) -> Column:
    """The lowest bytes of a whole number, least significant first."""
    number = _col(number).cast("bigint")
    hexed = [F.lpad(F.hex(F.shiftrightunsigned(number, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n_bytes)]
    return F.unhex(F.concat(*hexed))


def from_little_endian(data: Column | str, at: int, n_bytes: int) -> Column:
    """The unsigned number in bytes from position ``at`` (0 first), up to 7 bytes."""
    digits = [F.hex(F.substring(_col(data), at + i + 1, 1)) for i in reversed(range(n_bytes))]
    return F.conv(F.concat(*digits), 16, 10).cast("bigint")


def overwrite(data: Column | str, at: int, new: Column | str) -> Column:
    """Bytes from position ``at`` (0 first) replaced by others; what goes over the end is appended."""
    return F.overlay(_col(data), _col(new), F.lit(at + 1))


def smallest() -> Column:
    """Aggregate: the first key in order, as struct(klen, key)."""
    return F.min(F.struct("klen", "key"))


def largest() -> Column:
    """Aggregate: the last key in order."""
    return F.max(F.struct("klen", "key"))
