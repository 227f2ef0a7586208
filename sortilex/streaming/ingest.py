"""Streaming ingest: every micro-batch becomes a level, and the newest level wins on read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.keys import RUN_SCHEMA
from ..operators.merge import merge_multi
from ..sources.runs import Level, write_level


def ingest(stream: DataFrame, to_entries: Callable[[DataFrame], DataFrame], root: str, order: str, checkpoint: str | None = None, policy: str = "last") -> StreamingQuery:
    """Write each micro-batch of a stream as ``root/level-N``; ``order`` says which row of a key counts within a batch.

    A batch that is run again overwrites its own level, so each is stored once.
    """

    def store(batch: DataFrame, number: int) -> None:
        way = F.col("__order").asc() if policy == "first" else F.col("__order").desc()
        rows = to_entries(batch.withColumn("__order", F.col(order)))
        one = rows.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy(way))).where("__n = 1")
        write_level(one.select(*RUN_SCHEMA.fieldNames()), f"{root}/level-{number:06d}", level_id=number)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint or f"{root}/_checkpoint").trigger(availableNow=True).start()


def merged(spark: SparkSession, root: str, n_levels: int) -> DataFrame:
    """Entries of the ingested levels, newest first."""
    return merge_multi([Level.open(spark, f"{root}/level-{i:06d}").scan(ordered=False) for i in reversed(range(n_levels))])
