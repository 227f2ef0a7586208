"""A write buffer: batches of entries in order of arrival, with one visible version of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import RUN_SCHEMA
from ..operators.bounds import NEG_INF, POS_INF, Bound, scan


class MemTable:
    """``policy`` says which put of a key counts: the ``first`` (a put doesn't replace) or the ``last``."""

    def __init__(self, spark: SparkSession, table_id: int = 0, policy: str = "first") -> None:
        if policy not in ("first", "last"):
            raise ValueError("policy is first or last")
        self.spark, self.table_id, self.policy = spark, table_id, policy
        self._puts: DataFrame | None = None
        self._order: tuple[str, ...] = ()
        self._batches = 0

    def put(self, entries: DataFrame, *order: str) -> MemTable:
        """Take a batch; ``order`` names columns that say which of its rows came first."""
        if self._puts is not None and self._order != order:
            raise ValueError("all batches need the same order columns")
        self._order = order
        batch = entries.select(*RUN_SCHEMA.fieldNames(), F.struct(F.lit(self._batches).alias("batch"), *order).alias("seq"))
        self._puts = batch if self._puts is None else self._puts.unionByName(batch)
        self._batches += 1
        return self

    def put_values(self, pairs: list[tuple[bytes | str | int, bytes | str | int]], ts: int = 0) -> MemTable:
        """Take a few entries from the driver."""
        raw = [(k if isinstance(k, bytes) else str(k).encode(), v if isinstance(v, bytes) else str(v).encode()) for k, v in pairs]
        rows = [(bytearray(k), len(k), ts, bytearray(v), i) for i, (k, v) in enumerate(raw)]
        df = self.spark.createDataFrame(rows, "key binary, klen int, ts bigint, value binary, i bigint")
        return self.put(df.withColumn("ts", F.col("ts").cast("decimal(20,0)")), "i")

    def puts(self) -> DataFrame:
        """All that was put, in any number of versions."""
        return self._puts if self._puts is not None else self.spark.createDataFrame([], RUN_SCHEMA).withColumn("seq", F.struct(F.lit(0).alias("batch")))

    def entries(self) -> DataFrame:
        """The visible version of each key."""
        order = F.col("seq").asc() if self.policy == "first" else F.col("seq").desc()
        return self.puts().withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy(order))).where("__n = 1").select(*RUN_SCHEMA.fieldNames())

    def get(self, key: bytes | str | int) -> DataFrame:
        """The key's entry, or no row; the filter reaches the buffer before versions are compared."""
        k = key if isinstance(key, bytes) else str(key).encode()
        return self.entries().where(F.col("key") == F.lit(k))

    def get_or_empty(self, key: bytes | str | int) -> DataFrame:
        """One row: the value, or the empty one."""
        return self.get(key).agg(F.coalesce(F.first("value"), F.unhex(F.lit(""))).alias("value"))

    def scan(self, start: Bound = NEG_INF, end: Bound = POS_INF) -> DataFrame:
        return scan(self.entries(), start, end).orderBy("klen", "key")

    def stats(self) -> DataFrame:
        """One row: n_keys (visible), approximate_bytes (of all puts) and is_empty."""
        size = self.puts().agg(F.coalesce(F.sum(F.octet_length("key") + F.octet_length("value")), F.lit(0)).alias("approximate_bytes"), F.countDistinct("key").alias("n_keys"))
        return size.select("n_keys", "approximate_bytes", (F.col("n_keys") == 0).alias("is_empty"))

    def flush(self, path: str, **options):
        """Write the visible entries as a level and return it; the buffer is empty afterwards."""
        from .runs import write_level

        level = write_level(self.entries(), path, **options)
        self._puts = None
        return level
