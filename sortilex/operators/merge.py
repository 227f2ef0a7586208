"""Newest-source-wins merges of sources with the columns of entries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A newer source up to this many rows goes to every task; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def merge_bin(newer: DataFrame, older: DataFrame, broadcast_rows: int | None = None) -> DataFrame:
    """Union of two sources with unique keys; on equal keys the newer one's entry stays.

    The older, larger side isn't shuffled where the newer is small: give ``broadcast_rows`` to have it counted, otherwise
    the optimizer decides by its statistics.
    """
    keys = newer.select("key")
    if broadcast_rows is not None and newer.limit(broadcast_rows + 1).count() <= broadcast_rows:
        keys = F.broadcast(keys)
    return newer.unionByName(older.join(keys, "key", "left_anti").select(*newer.columns))


def ranked(sources: Sequence[DataFrame]) -> DataFrame:
    """All entries with their source's rank, newest (0) first."""
    return reduce(DataFrame.unionByName, [s.withColumn("src_rank", F.lit(i)) for i, s in enumerate(sources)])


def newest(ranked_entries: DataFrame, order_in_source: Column | str | None = None) -> DataFrame:
    """One entry a key, from the source of the lowest src_rank.

    Later duplicates within a source go too, by ``order_in_source`` and then by timestamp (the newest first) and value. Keys
    are taken together with their lengths, so a table dealt out by ranges of (klen, key) isn't dealt out again.
    """
    by = ["klen", "key"] if "klen" in ranked_entries.columns else ["key"]
    own = [] if order_in_source is None else [F.col(order_in_source) if isinstance(order_in_source, str) else order_in_source]
    rest = [F.desc("ts")] * ("ts" in ranked_entries.columns) + [F.col("value")] * ("value" in ranked_entries.columns)
    order = Window.partitionBy(*by).orderBy("src_rank", *own, *rest)
    return ranked_entries.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def merge_multi(sources: Sequence[DataFrame], order_in_source: Column | str | None = None) -> DataFrame:
    """One entry a key, from the newest source that has it; src_rank tells which.

    The window's limit of one row is applied before the shuffle as well as after it.
    """
    if not sources:
        raise ValueError("merge_multi needs a source; an empty one gives an empty merge")
    return newest(ranked(sources), order_in_source)


def active_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """One row: how many sources have entries (n_active)."""
    return ranked(sources).agg(F.countDistinct("src_rank").alias("n_active"))
