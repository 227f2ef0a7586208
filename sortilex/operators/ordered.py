"""Order-sensitive operators that don't gather a table in one task.

Positions and floor lookups work on range partitions: a table larger than ``LOCAL_BYTES`` is dealt out by key ranges and
written once, each range is numbered or filled alone, and one short row a range carries the result over to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import estimated_bytes, materialize

#: Plans up to this estimate are ordered by one window in one task.
LOCAL_BYTES = 32 << 20


def _ranges(df: DataFrame, order: tuple[Column, ...]) -> DataFrame:
    """The table by ranges of the order, with each range's number; written, as ranges are drawn from a sample."""
    return materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")


def with_position(df: DataFrame, *order: Column | str, name: str = "pos", local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """Adds each row's position (0 first) in an order that leaves no ties."""
    order = tuple(F.col(c) if isinstance(c, str) else c for c in order)
    if estimated_bytes(df) <= local_bytes:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1)
    dealt = _ranges(df, order)
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(before, F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn(name, own.cast("bigint") - 1).join(starts, "__range").withColumn(name, F.col(name) + F.col("__start")).drop("__range", "__start")


def nearest(probes: DataFrame, index: DataFrame, answer: str, names: dict[str, str], local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """Adds to each probe (klen, key) the ``answer`` of the index rows nearest to it, all in one pass over one order.

    ``names`` has the columns to add, by what they hold: ``at_most`` and ``below`` (the last index row up to, or before, the
    probe), ``at_least`` and ``above``; null where there is none. Index keys are unique. Frames only ever grow from the
    partition's start: looking ahead sorts the other way round.
    """
    probe_type = probes.select(F.struct("*").alias("p")).schema["p"].dataType
    entry = F.struct("klen", "key", F.col(answer).alias("answer"))
    rows = index.select("klen", "key", F.lit(0).alias("__side"), entry.alias("__at"), F.lit(None).cast(probe_type).alias("__probe"))
    asked = probes.select("klen", "key", F.lit(1).alias("__side"), F.lit(None).cast(rows.schema["__at"].dataType).alias("__at"), F.struct("*").alias("__probe"))
    both, wide = rows.unionByName(asked), True
    if estimated_bytes(both) <= local_bytes:
        filled, wide = both.withColumn("__range", F.lit(0)), False
    else:
        filled = _ranges(both, (F.col("klen"), F.col("key"), F.col("__side")))
        ends = filled.groupBy("__range").agg(F.max(F.when(F.col("__side") == 0, F.struct("klen", "key", "__at")))["__at"].alias("__last"), F.min(F.when(F.col("__side") == 0, F.struct("klen", "key", "__at")))["__at"].alias("__first"))
        earlier = F.last("__last", ignorenulls=True).over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
        later = F.last("__first", ignorenulls=True).over(Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1))
        filled = filled.join(ends.select("__range", earlier.alias("__earlier"), later.alias("__later")), "__range")
    out = []
    for with_equal, strict, carried, way in (("at_most", "below", "__earlier", F.asc), ("at_least", "above", "__later", F.desc)):
        if not {with_equal, strict} & names.keys():
            continue
        order = Window.partitionBy("__range").orderBy(way("klen"), way("key"), "__side")  # of equal keys, the index's first
        beyond = F.last("__at", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        filled = filled.withColumn("__beyond", F.coalesce(beyond, F.col(carried)) if wide else beyond)
        here = F.last(F.when(F.col("__side") == 0, F.struct("__at", "__beyond")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        filled = filled.withColumn(f"__{with_equal}", here).drop("__beyond")
        near = F.coalesce(F.col(f"__{with_equal}.__at"), F.col(carried)) if wide else F.col(f"__{with_equal}.__at")
        equal = (F.col(f"__{with_equal}.__at.klen") == F.col("klen")) & (F.col(f"__{with_equal}.__at.key") == F.col("key"))
        far = F.when(equal, F.col(f"__{with_equal}.__beyond")).otherwise(near)
        out += [x["answer"].alias(names[kind]) for kind, x in ((with_equal, near), (strict, far)) if kind in names]
    return filled.where(F.col("__side") == 1).select("__probe.*", *out)


def floor_lookup(probes: DataFrame, index: DataFrame, answer: str, strict: bool = False, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """Adds to each probe (klen, key) the ``answer`` of the last index row at or before it (strict: before), else null."""
    return nearest(probes, index, answer, {"below" if strict else "at_most": answer}, local_bytes)


def ceiling_lookup(probes: DataFrame, index: DataFrame, answer: str, strict: bool = False, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """Adds the ``answer`` of the first index row at or after each probe (strict: after), else null."""
    return nearest(probes, index, answer, {"above" if strict else "at_least": answer}, local_bytes)


def adjacent(entries: DataFrame, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """Adds the keys before and after each entry's (``previous``, ``next``; null past either end), without a join of the table."""
    before = lambda order: F.lag("key").over(order)
    after = lambda order: F.lead("key").over(order)
    if estimated_bytes(entries) <= local_bytes:
        order = Window.orderBy("klen", "key")
        return entries.withColumns({"previous": before(order), "next": after(order)})
    dealt = _ranges(entries, (F.col("klen"), F.col("key")))
    ends = dealt.groupBy("__range").agg(F.min(F.struct("klen", "key"))["key"].alias("f"), F.max(F.struct("klen", "key"))["key"].alias("l"))
    seams = Window.orderBy("__range")  # one short row a range
    ends = ends.select("__range", F.lag("l").over(seams).alias("__earlier"), F.lead("f").over(seams).alias("__later"))
    own = Window.partitionBy("__range").orderBy("klen", "key")
    out = dealt.join(ends, "__range").withColumns({"previous": F.coalesce(before(own), "__earlier"), "next": F.coalesce(after(own), "__later")})
    return out.drop("__range", "__earlier", "__later")


def step(entries: DataFrame, by: int = 1, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """Each entry with the key ``by`` places on in the order (negative: back), as ``other``; null past either end."""
    if abs(by) == 1:
        near, far = ("next", "previous") if by > 0 else ("previous", "next")
        return adjacent(entries, local_bytes).drop(far).withColumnRenamed(near, "other")
    placed = with_position(entries, "klen", "key", local_bytes=local_bytes)
    other = placed.select((F.col("pos") - by).alias("pos"), F.col("key").alias("other"))
    return placed.join(other, "pos", "left").drop("pos")


def erase(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries whose key is not in ``keys``."""
    return entries.join(keys.select("key").distinct(), "key", "left_anti")


def insert_missing(entries: DataFrame, more: DataFrame) -> DataFrame:
    """Entries and those of ``more`` with new keys; both have unique keys."""
    return entries.unionByName(more.join(entries.select("key"), "key", "left_anti").select(*entries.columns))


def ends(entries: DataFrame) -> DataFrame:
    """One row: the first and the last key."""
    return entries.agg(F.min(F.struct("klen", "key"))["key"].alias("first_key"), F.max(F.struct("klen", "key"))["key"].alias("last_key"))
