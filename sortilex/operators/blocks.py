"""Logical blocks of a sorted run: numbering, metadata, index lookups.

Physical blocks are Parquet's business. These give the *numbers* that an index of blocks would: by a fixed count of
entries, or by the byte budget of a prefix-compressed block.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import ship
from .ordered import floor_lookup, with_position

#: Bytes of an entry besides its key's rest and its value, of its offset, and of the entry count at the end.
ENTRY_BYTES, OFFSET_BYTES, COUNT_BYTES = 14, 2, 2


def fixed_blocks(entries: DataFrame, per_block: int) -> DataFrame:
    """Adds pos (in the run), block and idx (in the block) for blocks of a fixed number of entries."""
    placed = with_position(entries, "klen", "key")
    return placed.withColumns({"block": F.floor(F.col("pos") / per_block).cast("bigint"), "idx": F.pmod(F.col("pos"), F.lit(per_block)).cast("bigint")})


def _overlap(a: bytes, b: bytes) -> int:
    return len(os.path.commonprefix((a, b)))


def packed_blocks(entries: DataFrame, block_bytes: int, files: int | None = None) -> DataFrame:
    """Adds file, block (in the file) and idx for blocks cut by size.

    A block ends with the entry that takes it over ``block_bytes``; keys share a prefix with the block's first key that
    isn't empty. The cut depends on all entries before it, so each file (a key range) is one sequential pass that holds
    one batch of rows. Without ``files`` the session's shuffle partitions decide.
    """
    number = [] if files is None else [files]
    ordered = entries.select("key", "klen", "ts", "value").repartitionByRange(*number, "klen", "key").sortWithinPartitions("klen", "key")
    schema = "key binary, klen int, ts decimal(20,0), value binary, file int, block bigint, idx bigint"

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        file, block, idx, size, first = TaskContext.get().partitionId(), 0, 0, COUNT_BYTES, b""
        for part in parts:
            blocks, places = [], []
            for key, value in zip(part["key"], part["value"], strict=True):
                blocks.append(block)
                places.append(idx)
                size += ENTRY_BYTES + OFFSET_BYTES + len(key) - _overlap(key, first) + len(value)
                idx += 1
                first = first or key
                if size > block_bytes:
                    block, idx, size, first = block + 1, 0, COUNT_BYTES, b""
            yield part.assign(file=file, block=blocks, idx=places)

    ship(entries.sparkSession)
    return ordered.mapInPandas(cut, schema)


def block_meta(blocked: DataFrame, *by: str) -> DataFrame:
    """One row a block (of a file, with ``by``): first and last key, entries, bytes of keys and values, largest ts."""
    found = blocked.groupBy(*by, "block").agg(F.min(F.struct("klen", "key")).alias("f"), F.max(F.struct("klen", "key")).alias("l"), F.count("*").alias("n_keys"), F.sum(F.octet_length("key") + F.octet_length("value")).alias("n_bytes"), F.max("ts").alias("max_ts"))
    return found.select(*by, "block", F.col("f.klen").alias("first_klen"), F.col("f.key").alias("first_key"), F.col("l.klen").alias("last_klen"), F.col("l.key").alias("last_key"), "n_keys", "n_bytes", "max_ts")


def locate_block(probes: DataFrame, meta: DataFrame, number: str = "block") -> DataFrame:
    """Adds the number of the last block (or file) whose first key is at most the probe's, else 0."""
    index = meta.select(F.col("first_klen").alias("klen"), F.col("first_key").alias("key"), number)
    return floor_lookup(probes, index, number).withColumn(number, F.coalesce(number, F.lit(0)))


def locate_key(probes: DataFrame, block: DataFrame, inclusive: bool = True, start: bool = True) -> DataFrame:
    """Adds idx: for a range's start the last entry at or before the probe (0 if none), for its end the first one beyond.

    ``block`` has klen, key and idx; ``inclusive`` matters for an end only.
    """
    if start:
        return floor_lookup(probes, block, "idx").withColumn("idx", F.coalesce("idx", F.lit(0)))
    found = floor_lookup(probes, block, "idx", strict=not inclusive)
    return found.withColumn("idx", F.coalesce(F.col("idx") + 1, F.lit(0)))


def entries_from(blocked: DataFrame, idx: int) -> DataFrame:
    """Entries of a block from a position on."""
    return blocked.where(F.col("idx") >= idx)


def entry_at(blocked: DataFrame, idx: int) -> DataFrame:
    return blocked.where(F.col("idx") == idx)


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def prefix_compressed(blocked: DataFrame, overlap: Column) -> DataFrame:
    """Adds overlap (with first_key) and rest, from which splice() makes the key again."""
    from ..functions.keys import rest_after

    return blocked.withColumn("overlap", overlap).withColumn("rest", rest_after("key", "overlap"))
