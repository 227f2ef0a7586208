"""Range bounds: minus or plus infinity, or a key with or without itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bound:
    """``infinity`` is -1 or +1 for an open end, 0 for a key."""

    infinity: int = 0
    key: bytes = b""
    inclusive: bool = True

    @staticmethod
    def at(key: bytes | str | int, inclusive: bool = True) -> Bound:
        return Bound(0, key if isinstance(key, bytes) else str(key).encode(), inclusive)


NEG_INF, POS_INF = Bound(-1), Bound(1)


def is_valid(start: Bound, end: Bound) -> bool:
    """Whether a range can hold a key; an invalid range is empty, not an error."""
    if start.infinity or end.infinity:
        return start.infinity <= 0 <= end.infinity
    if start.key == end.key:
        return start.inclusive and end.inclusive
    return (len(start.key), start.key) < (len(end.key), end.key)


def in_range(start: Bound = NEG_INF, end: Bound = POS_INF) -> Column:
    """Predicate on klen and key, in the OR form that Parquet scans take as a pushed filter."""
    if not is_valid(start, end):
        return F.lit(False)
    out = F.lit(True)
    for bound, lower in ((start, True), (end, False)):
        if not bound.infinity:
            n, k = F.lit(len(bound.key)), F.lit(bound.key)
            klen, key = F.col("klen"), F.col("key")
            beyond = klen > n if lower else klen < n
            within = (key >= k if bound.inclusive else key > k) if lower else (key <= k if bound.inclusive else key < k)
            out = out & (beyond | ((klen == n) & within))
    return out


def scan(entries: DataFrame, start: Bound = NEG_INF, end: Bound = POS_INF) -> DataFrame:
    """Entries between two bounds, unordered; any source of entries will do."""
    return entries.where(in_range(start, end))
