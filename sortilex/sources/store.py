"""A store: a write buffer and levels below it, read newest first.

Each source is cut to the range, and levels to the files that can hold it, before anything is merged.

Edge cases. No buffer, no levels, or nothing in them: empty results. A key in several sources: the newest one's entry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.keys import RUN_SCHEMA
from ..operators.bounds import NEG_INF, POS_INF, Bound, scan
from ..operators.merge import merge_multi
from .memtable import MemTable
from .runs import Level, compact


class Store:
    """``levels`` come newest first, below the buffer."""

    def __init__(self, spark: SparkSession, buffer: MemTable | None = None, levels: Sequence[Level] = ()) -> None:
        self.spark, self.buffer, self.levels = spark, buffer or MemTable(spark), list(levels)

    def sources(self, start: Bound = NEG_INF, end: Bound = POS_INF) -> list[DataFrame]:
        """Entries of each source between two bounds, newest first."""
        return [scan(self.buffer.entries(), start, end), *(x.scan(start, end, ordered=False) for x in self.levels)]

    def scan(self, start: Bound = NEG_INF, end: Bound = POS_INF, ordered: bool = True) -> DataFrame:
        """One entry a key between two bounds."""
        found = merge_multi(self.sources(start, end)).select(*RUN_SCHEMA.fieldNames())
        return found.orderBy("klen", "key") if ordered else found

    def get(self, key: bytes | str | int) -> DataFrame:
        """The key's entry, or no row; of each level one file is opened at most."""
        return merge_multi([self.buffer.get(key), *(x.get(key) for x in self.levels)]).select(*RUN_SCHEMA.fieldNames())

    def get_many(self, keys: DataFrame) -> DataFrame:
        """Entries of the keys (klen, key) that any source has."""
        own = self.buffer.entries().join(keys.select("klen", "key").distinct(), ["klen", "key"], "left_semi").select(*RUN_SCHEMA.fieldNames())
        return merge_multi([own, *(x.get_many(keys) for x in self.levels)]).select(*RUN_SCHEMA.fieldNames())

    def flush(self, path: str, **options) -> Level:
        """The buffer becomes the newest level."""
        level = self.buffer.flush(path, **options)
        self.levels.insert(0, level)
        return level

    def compact(self, path: str, **options) -> Level:
        """All levels become one; the buffer stays."""
        level = compact([x.scan(ordered=False) for x in self.levels] or [self.spark.createDataFrame([], RUN_SCHEMA)], path, **options)
        self.levels = [level]
        return level
