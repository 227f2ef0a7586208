"""Sorted runs as Parquet: a level is a folder of files with disjoint, ascending key ranges, and a manifest.

Files come from a range partition on (klen, key), are sorted inside and carry a Bloom filter on the key and a checksum for
every page, so Parquet's own statistics and filters serve scans and point lookups. A file is written in several parts, each
a Parquet file of a range of its own, where one task would have to sort more than ``PART_BYTES``. The manifest has one row a
file and prunes files before any is opened; each row has a checksum and the number of files, and opening a level checks both.

Edge cases. No entries: a level without files. A manifest that is missing, or that lacks rows or has others than were
written: opening fails. Damaged pages: reading fails where ``verify`` is on.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import RUN_SCHEMA
from ..operators.blocks import COUNT_BYTES, ENTRY_BYTES, OFFSET_BYTES, locate_block
from ..operators.bloom import Bloom, Parameters
from ..operators.bounds import NEG_INF, POS_INF, Bound, is_valid, scan
from .storage import estimated_bytes

MANIFEST, FILTER = "_manifest", "_filter"
BLOCK_BYTES = 128 << 20
#: Row groups are no smaller: a writer keeps each one's Bloom filter (1 MB where the number of keys isn't given) and statistics until the file ends.
ROW_GROUP_BYTES = 16 << 20
#: What one task sorts, about: bytes of keys and values, and of a row besides them. Plans that are estimated below SMALL_PLAN aren't counted.
PART_BYTES, ROW_BYTES, SMALL_PLAN = 128 << 20, 100, 32 << 20


def arranged(entries: DataFrame, files: int | None = None) -> DataFrame:
    """Entries by ranges of (klen, key), a partition a file; without ``files`` adaptive execution sizes them."""
    return entries.repartitionByRange(*([] if files is None else [files]), "klen", "key")


def parts(entries: DataFrame, files: int | None = None) -> int | None:
    """How many ranges entries are dealt out to, so that a task's share has a bound: ``files`` at least, if given.

    Counted from keys and values; without ``files`` None where the session's shuffle partitions are enough.
    """
    if estimated_bytes(entries) <= SMALL_PLAN:
        return files
    n, size = entries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key") + F.octet_length("value")), F.lit(0))).first()
    needed = -(-(size + n * ROW_BYTES) // PART_BYTES)
    if files is None:
        return needed if needed > int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    return max(files, needed)


def write_run(entries: DataFrame, path: str, files: int | None = None, expected_keys: int | None = None, fpp: float = 0.01, block_bytes: int = BLOCK_BYTES, is_arranged: bool = False) -> None:
    """Write entries (unique keys) as sorted files, large ones in parts; entries that come from arranged() aren't dealt out again.

    Row groups hold ``block_bytes``, or ``ROW_GROUP_BYTES`` if blocks are smaller; such blocks are numbers, as in operators/blocks.
    """
    own = entries.select(*RUN_SCHEMA.fieldNames())
    ordered = (own if is_arranged else arranged(own, parts(own, files))).sortWithinPartitions("klen", "key")
    out = ordered.write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(fpp)).option("parquet.block.size", max(block_bytes, ROW_GROUP_BYTES))
    (out.option("parquet.bloom.filter.expected.ndv#key", str(expected_keys)) if expected_keys else out).parquet(path)


def estimated_size(entries: DataFrame) -> DataFrame:
    """One row, before anything is written: n_entries and estimated_bytes of keys, values and their places in blocks."""
    each = F.octet_length("key") + F.octet_length("value") + ENTRY_BYTES + OFFSET_BYTES
    return entries.agg(F.count("*").alias("n_entries"), (F.coalesce(F.sum(each), F.lit(0)) + COUNT_BYTES).cast("bigint").alias("estimated_bytes"))


def describe(spark: SparkSession, path: str, level_id: int = 0, block_bytes: int = BLOCK_BYTES, files: int | None = None) -> DataFrame:
    """A row for each file: level_id, sst_id, paths of its parts, first and last key, num_rows, max_ts, file_bytes and n_blocks.

    Reads keys and timestamps only. More parts than ``files`` make up so many files of parts that follow each other; without
    it each part is one. n_blocks is how many blocks of ``block_bytes`` the file takes up.
    """
    rows = spark.read.schema(RUN_SCHEMA).parquet(path).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_bytes"))
    size = F.element_at(F.collect_set("file_bytes"), 1)  # collecting has rows aggregated as objects; least keys alone would have them all sorted
    each = rows.groupBy("path").agg(size.alias("file_bytes"), F.min(F.struct("klen", "key")).alias("f"), F.max(F.struct("klen", "key")).alias("l"), F.count("*").alias("num_rows"), F.max("ts").alias("max_ts"))
    place, n = F.row_number().over(Window.orderBy("f", "file_bytes")) - 1, F.count("*").over(Window.partitionBy())  # a row for each part; the size in the order, else it might be left out
    number = place if files is None else F.when(n <= files, place).otherwise(F.floor(place * files / n)).cast("int")
    found = each.withColumn("sst_id", number).groupBy("sst_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "path"))), lambda p: p["path"]).alias("paths"), F.min("f").alias("f"), F.max("l").alias("l"), F.sum("num_rows").alias("num_rows"), F.max("max_ts").alias("max_ts"), F.sum("file_bytes").alias("file_bytes"))
    return found.select(F.lit(level_id).alias("level_id"), "sst_id", "paths", F.col("f.klen").alias("first_klen"), F.col("f.key").alias("first_key"), F.col("l.klen").alias("last_klen"), F.col("l.key").alias("last_key"), "num_rows", "max_ts", "file_bytes", F.ceil(F.col("file_bytes") / block_bytes).cast("bigint").alias("n_blocks"))


def _row_checksum(columns: list[str]) -> Column:
    text = [F.coalesce(F.col(c).cast("string") if c.endswith("_id") or c in ("path", "paths") else F.hex(F.col(c).cast("string").cast("binary")), F.lit("-")) for c in columns]
    return F.crc32(F.concat_ws("|", *text).cast("binary"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One short row a file, with its checksum and how many rows there are."""
    n = F.count("*").over(Window.partitionBy())
    manifest.withColumns({"row_crc": _row_checksum(manifest.columns), "n_files": n}).coalesce(1).write.parquet(f"{path}/{MANIFEST}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Checked; ValueError if it isn't what was written."""
    rows = spark.read.parquet(f"{path}/{MANIFEST}")
    own = [c for c in rows.columns if c not in ("row_crc", "n_files")]
    wrong, n, said, least = rows.agg(F.count(F.when(F.col("row_crc") != _row_checksum(own), 1)), F.count("*"), F.max("n_files"), F.min("n_files")).first()
    if wrong or n != (said or 0) or said != least:
        raise ValueError(f"the manifest of {path} is damaged")
    return rows.select(*(F.array(c).alias("paths") if c == "path" else c for c in own))  # files had no parts once


class Level:
    """Sorted files that don't overlap; ``verify`` has every page's checksum compared when it is read."""

    def __init__(self, spark: SparkSession, manifest: DataFrame, check: bool = True, verify: bool = False, key_filter: Bloom | None = None) -> None:
        self.spark, self.manifest, self.verify, self.key_filter = spark, manifest, verify, key_filter
        self._pinned: dict[tuple[str, ...], DataFrame] = {}
        if check and not self.overlaps().isEmpty():
            raise ValueError("files of a level overlap")

    def overlaps(self) -> DataFrame:
        """Files that begin at or before the end of the one before."""
        order = Window.orderBy("first_klen", "first_key")
        before = F.lag(F.struct("last_klen", "last_key")).over(order)
        return self.manifest.withColumn("before", before).where(F.struct(F.col("first_klen").alias("last_klen"), F.col("first_key").alias("last_key")) <= F.col("before")).drop("before")

    @staticmethod
    def open(spark: SparkSession, path: str, verify: bool = False, with_filter: bool = False) -> Level:
        """What write_level wrote; ``with_filter`` reads the key filter that was written beside it."""
        return Level(spark, read_manifest(spark, path), False, verify, Bloom.read(spark, f"{path}/{FILTER}") if with_filter else None)

    @staticmethod
    def assemble(spark: SparkSession, levels: Sequence[Level], level_id: int = 0) -> Level:
        """One level of several levels' files, numbered anew; they may not overlap."""
        every = levels[0].manifest
        for x in levels[1:]:
            every = every.unionByName(x.manifest)
        number = F.row_number().over(Window.orderBy("first_klen", "first_key")) - 1
        return Level(spark, every.withColumns({"level_id": F.lit(level_id), "sst_id": number}))

    def count(self) -> int:
        return self.manifest.count()

    def sstable(self, sst_id: int) -> DataFrame:
        """Entries of one file, in order."""
        return self._read([r[0] for r in self.manifest.where(F.col("sst_id") == sst_id).select(F.explode("paths")).collect()], exactly=True)

    def _read(self, paths: list[str], exactly: bool = False) -> DataFrame:
        """Entries of files; unless ``exactly`` is asked for, others of pinned ones may come with them."""
        if not paths:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        pinned = [df for held, df in self._pinned.items() if (set(held) == set(paths) if exactly else set(held) >= set(paths))]
        if pinned:
            return pinned[0]
        if exactly and len(paths) > 1:  # a scan for each part keeps their order
            return reduce(DataFrame.unionByName, [self._read([p], exactly=True) for p in paths])
        return self.spark.read.option("parquet.page.verify-checksum.enabled", str(self.verify).lower()).schema(RUN_SCHEMA).parquet(*paths)

    def pin(self, start: Bound = NEG_INF, end: Bound = POS_INF) -> Level:
        """Keep the files that a range can touch in the executors' memory and disks, for the reads that they can answer."""
        paths = tuple(self.files_for(start, end))
        if paths and paths not in self._pinned:
            self._pinned[paths] = self._read(list(paths)).persist()
        return self

    def release(self) -> None:
        """Give up what is pinned."""
        for df in self._pinned.values():
            df.unpersist()
        self._pinned.clear()

    def files_for(self, start: Bound = NEG_INF, end: Bound = POS_INF) -> list[str]:
        """Paths of the files that a range can touch, with all their parts."""
        if not is_valid(start, end):
            return []
        df = self.manifest
        if not start.infinity:
            df = df.where((F.col("last_klen") > len(start.key)) | ((F.col("last_klen") == len(start.key)) & (F.col("last_key") >= F.lit(start.key))))
        if not end.infinity:
            df = df.where((F.col("first_klen") < len(end.key)) | ((F.col("first_klen") == len(end.key)) & (F.col("first_key") <= F.lit(end.key))))
        return [r[0] for r in df.orderBy("sst_id").select(F.explode("paths")).collect()]

    def scan(self, start: Bound = NEG_INF, end: Bound = POS_INF, ordered: bool = True) -> DataFrame:
        """Entries between two bounds; only files that can hold some are opened."""
        found = scan(self._read(self.files_for(start, end)), start, end)
        return found.orderBy("klen", "key") if ordered else found

    def get(self, key: bytes | str | int) -> DataFrame:
        """The key's entry, from one file at most, by statistics and Bloom filter."""
        bound = Bound.at(key)
        return self._read(self.files_for(bound, bound)).where((F.col("klen") == len(bound.key)) & (F.col("key") == F.lit(bound.key)))

    def get_many(self, keys: DataFrame) -> DataFrame:
        """Entries of the keys (klen, key) that the level has.

        The key filter, where the level has one, drops keys that are surely absent; files beyond the others aren't opened.
        """
        asked = keys.select("klen", "key").where("key is not null").distinct()
        if self.key_filter is not None:
            asked = self.key_filter.contains(asked).where("maybe").drop("maybe")
        first, last = asked.agg(F.min(F.struct("klen", "key"))["key"], F.max(F.struct("klen", "key"))["key"]).first()
        if first is None:
            return self._read([])
        start, end = Bound.at(bytes(first)), Bound.at(bytes(last))
        return scan(self._read(self.files_for(start, end)), start, end).join(asked, ["klen", "key"], "left_semi").select(*RUN_SCHEMA.fieldNames())

    def locate_sstable(self, probes: DataFrame) -> DataFrame:
        """Adds sst_id: the last file that begins at or before each probe, else 0."""
        return locate_block(probes, self.manifest, "sst_id")


def write_level(entries: DataFrame, path: str, level_id: int = 0, with_filter: bool = False, verify: bool = False, **options) -> Level:
    """Write a run with its manifest (and a filter of its keys) and open it."""
    spark = entries.sparkSession
    write_run(entries, path, **options)
    write_manifest(describe(spark, path, level_id, options.get("block_bytes", BLOCK_BYTES), options.get("files")), path)
    if with_filter:
        rows = Level.open(spark, path)
        n = rows.manifest.agg(F.coalesce(F.sum("num_rows"), F.lit(0))).first()[0]
        Bloom.build(rows.scan(ordered=False), Parameters(max(1, n), options.get("fpp", 0.01))).write(f"{path}/{FILTER}")
    return Level.open(spark, path, verify, with_filter)


def compact(sources: Sequence[DataFrame], path: str, files: int | None = None, **options) -> Level:
    """Merge sources, newest first, into a new level: dealt out once by key range, merged and written there."""
    from ..operators.merge import newest, ranked

    every = ranked(sources)
    return write_level(newest(arranged(every, parts(every, files))), path, files=files, is_arranged=True, **options)
