"""Blocked Bloom filters as tables of 64-bit words.

A filter is a DataFrame of (bucket, word, bits) rows, so it can be of any size. One hash of a key chooses a bucket of
``BUCKET_BITS`` bits at most, another its places within. A small filter is built by one aggregation of words that combines on the
map side; beyond ``COMBINED_BUCKETS`` each different key is dealt out once, to its bucket, and words are made there. A probe row
meets one bucket (by broadcast up to ``BROADCAST_BYTES``, else by one join on the bucket), and union, intersection and
difference are aggregations of words. A table of several buckets gets a multiple of 8 of them beyond 8, so that it folds.

Edge cases. A null key is a key like any other. Nothing inserted: nothing is contained. Repeated keys set the same bits, and
each counts as inserted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_HASHES = 999
BUCKET_BITS = 4096
#: Size of a filter that goes to every task.
BROADCAST_BYTES = 8 << 20
#: Up to so many buckets (1 MB) words are combined before they are dealt out; of larger filters a task's keys hardly share words.
COMBINED_BUCKETS = 2048
#: Buckets that a task makes beyond that. The number of tasks is fixed, so that it isn't cut down: unions read all their filters' shares in one task.
BUCKETS_A_TASK = 1024


@dataclass(frozen=True)
class Parameters:
    """Expected elements and false-positive probability; limits as given."""

    elements: int = 10_000
    fpp: float = 1 / 10_000
    seed: int = 7_919
    least_size: int = 1
    most_size: int = 1 << 62
    least_hashes: int = 1
    most_hashes: int = MOST_HASHES

    def optimal(self) -> tuple[int, int]:
        """Number of hashes and bits: the smallest table, in whole bytes. ValueError if no filter can be like this."""
        possible = self.elements > 0 and 0 < self.fpp < 1
        ordered = 0 < self.least_hashes <= self.most_hashes and 0 < self.least_size <= self.most_size
        if not (possible and ordered):
            raise ValueError(f"no Bloom filter has {self}")
        bits, k = min((self.bits(k), k) for k in range(1, MOST_HASHES + 1))
        size = -(-int(bits) // 8) * 8
        return min(max(k, self.least_hashes), self.most_hashes), min(max(size, self.least_size), self.most_size)

    def bits(self, k: int) -> float:
        miss = 1 - self.fpp ** (1 / k)
        return -k * self.elements / math.log(miss) if 0 < miss < 1 else math.inf


@dataclass(frozen=True)
class Bloom:
    """A filter: its words, number of hashes, buckets and bits of each, seed, and the tables that went in and aren't counted yet."""

    words: DataFrame
    hashes: int
    buckets: int
    bucket_bits: int
    seed: int
    counted: int = 0
    uncounted: tuple[DataFrame, ...] = ()

    @property
    def table_size(self) -> int:
        """Bits, in whole buckets."""
        return self.buckets * self.bucket_bits

    @property
    def inserted(self) -> int:
        """Number of elements that went in."""
        return self.counted + sum(df.count() for df in self.uncounted)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.seed)), F.lit(self.buckets)).cast("int")

    def _places(self, h: Column) -> list[Column]:
        """In the bucket: steps of an odd width from a start, both by a second hash of the key."""
        start, width = F.pmod(h, F.lit(self.bucket_bits)), F.pmod(F.shiftrightunsigned(h, 24), F.lit(self.bucket_bits // 2)) * 2 + 1
        return [F.pmod(start + i * width, F.lit(self.bucket_bits)).cast("int") for i in range(self.hashes)]

    def _second(self, key: Column) -> Column:
        return F.xxhash64(F.lit(self.seed), key)

    @staticmethod
    def build(keys: DataFrame, parameters: Parameters | None = None, column: str = "key") -> Bloom:
        """Of a table's keys."""
        p = parameters or Parameters()
        hashes, size = p.optimal()
        buckets = -(-size // BUCKET_BITS)
        buckets = -(-buckets // 8) * 8 if buckets > 8 else buckets
        bits = -(-size // (64 * buckets)) * 64
        none = keys.sparkSession.createDataFrame([], "bucket int, word int, bits bigint")
        return Bloom(none, hashes, buckets, bits, p.seed).insert(keys, column)

    def insert(self, keys: DataFrame, column: str = "key") -> Bloom:
        hashed = keys.select(self._bucket(F.col(column)).alias("bucket"), self._second(F.col(column)).alias("h"))
        if self.buckets > COMBINED_BUCKETS:
            hashed = hashed.distinct().repartition(-(-self.buckets // BUCKETS_A_TASK), "bucket")
        each = hashed.select("bucket", F.explode(F.array(*self._places(F.col("h")))).alias("place"))
        new = each.groupBy("bucket", F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place").bitwiseAND(63))).alias("bits"))
        empty = not self.counted and not self.uncounted
        words = new if empty else _combined([self.words, new], F.bit_or("bits"))
        return replace(self, words=words, uncounted=(*self.uncounted, keys.select(column)))

    def contains(self, probes: DataFrame, column: str = "key") -> DataFrame:
        """Adds ``maybe`` to each probe: false means surely absent."""
        every = F.sequence(F.lit(0), F.lit(self.bucket_bits // 64 - 1))
        held = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
        dense = self.words.groupBy("bucket").agg(held.alias("m")).select(F.col("bucket").alias("__b"), F.transform(every, lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("bigint"))).alias("__words"))
        dense = F.broadcast(dense) if self.table_size // 8 <= BROADCAST_BYTES else dense
        met = probes.withColumn("__bucket", self._bucket(F.col(column))).join(dense, F.col("__bucket") == F.col("__b"), "left")
        bits = [F.getbit(F.get("__words", F.shiftright(p, 6)), p.bitwiseAND(63)) == 1 for p in self._places(self._second(F.col(column)))]
        return met.withColumn("maybe", F.coalesce(reduce(Column.__and__, bits), F.lit(False))).drop("__bucket", "__b", "__words")

    def contains_all(self, probes: DataFrame, column: str = "key") -> DataFrame:
        return self.contains(probes, column).agg(F.coalesce(F.bool_and("maybe"), F.lit(True)).alias("contains_all"))

    def contains_none(self, probes: DataFrame, column: str = "key") -> DataFrame:
        return self.contains(probes, column).agg(F.coalesce(~F.bool_or("maybe"), F.lit(True)).alias("contains_none"))

    def _matches(self, other: Bloom) -> bool:
        return (self.hashes, self.buckets, self.bucket_bits, self.seed) == (other.hashes, other.buckets, other.bucket_bits, other.seed)

    def __and__(self, other: Bloom) -> Bloom:
        """Intersection; a filter of other parameters leaves this one as it is, as for | and ^."""
        both = _combined([self.words, other.words], F.when(F.count("*") == 2, F.bit_and("bits")).otherwise(0).cast("bigint"))
        return replace(self, words=both) if self._matches(other) else self

    def __or__(self, other: Bloom) -> Bloom:
        either = _combined([self.words, other.words], F.bit_or("bits"))
        return replace(self, words=either, counted=self.counted + other.counted, uncounted=self.uncounted + other.uncounted) if self._matches(other) else self

    def __xor__(self, other: Bloom) -> Bloom:
        return replace(self, words=_combined([self.words, other.words], F.bit_xor("bits"))) if self._matches(other) else self

    def __bool__(self) -> bool:
        return self.table_size > 0

    def same_as(self, other: Bloom) -> bool:
        return self._matches(other) and self.inserted == other.inserted and (self ^ other).words.isEmpty()

    def set_bits(self) -> DataFrame:
        """One row: the number of bits that are set."""
        return self.words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("bigint").alias("set_bits"))

    def effective_fpp(self) -> float:
        """False-positive probability at the number of elements that went in."""
        return (1 - math.exp(-self.hashes * self.inserted / self.table_size)) ** self.hashes

    def cleared(self) -> Bloom:
        return replace(self, words=self.words.limit(0), counted=0, uncounted=())

    def folded(self, table_size: int) -> Bloom:
        """A smaller filter: buckets beyond the new size fall on the remainder. It has to take up whole buckets, and divide the old."""
        if table_size < 1 or self.table_size % table_size or table_size % self.bucket_bits:
            raise ValueError("the new size has to divide the old one, in whole buckets")
        buckets = table_size // self.bucket_bits
        onto = self.words.withColumn("bucket", F.pmod("bucket", F.lit(buckets)).cast("int"))
        return replace(self, words=_combined([onto], F.bit_or("bits")), buckets=buckets)

    def write(self, path: str) -> None:
        """Words and parameters, as Parquet tables."""
        self.words.write.parquet(f"{path}/words")
        spark = self.words.sparkSession
        spark.createDataFrame([(self.hashes, self.buckets, self.bucket_bits, self.seed, self.inserted)], "hashes int, buckets bigint, bucket_bits int, seed bigint, inserted bigint").coalesce(1).write.parquet(f"{path}/parameters")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Bloom:
        return Bloom(spark.read.parquet(f"{path}/words"), *spark.read.parquet(f"{path}/parameters").first())


def _combined(tables: list[DataFrame], bits: Column) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).groupBy("bucket", "word").agg(bits.alias("bits")).where("bits <> 0")


def parameter_table(wanted: DataFrame) -> DataFrame:
    """Adds the optimal n_hashes and table_size to rows of elements and fpp, as one expression."""
    k = F.sequence(F.lit(1), F.lit(MOST_HASHES))
    bits = F.transform(k, lambda i: F.struct((-i * F.col("elements") / F.ln(1 - F.pow(F.col("fpp"), 1 / i.cast("double")))).alias("m"), i.alias("k")))
    best = F.array_min(bits)
    return wanted.withColumn("best", best).select("elements", "fpp", F.col("best.k").cast("bigint").alias("n_hashes"), (F.ceil(F.floor("best.m") / 8) * 8).cast("bigint").alias("table_size"))
