"""Queries over the sorted key/value operators, with the SQL that each should equal.

Results are compared without order, so queries that promise one return positions. Keys come out as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import blocks as B
from ..operators import merge as M
from ..operators import ordered as O
from ..operators.bloom import Bloom, Parameters, parameter_table
from ..operators.bounds import NEG_INF, POS_INF, Bound, scan
from ..sources.memtable import MemTable
from ..sources.runs import Level, compact, describe, estimated_size, write_level
from ..sources.storage import new_path
from ..sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries o_orderkey -> o_orderstatus, with the customer as timestamp."""
    return K.entries(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", "o_custkey")


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def shown(entries: DataFrame) -> DataFrame:
    return entries.select(text("key").alias("key"), F.col("ts").cast("bigint").alias("ts"), text("value").alias("value"))


ENTRIES = "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_custkey AS ts, o_orderstatus AS value FROM orders"


# --- Order and ranges ---------------------------------------------------------------------------------------------


@query(f"SELECT key, row_number() OVER (ORDER BY strlen(key), key) - 1 AS pos FROM ({ENTRIES})")
def shortlex_rank(spark, sf_dir):
    """Full scan in order."""
    placed = O.with_position(orders(spark, sf_dir).select("key", "klen"), "klen", "key")
    return placed.select(text("key").alias("key"), "pos")


def _ranges(start: Bound, end: Bound) -> str:
    """The same range as SQL."""
    out = []
    for bound, op in ((start, ">"), (end, "<")):
        if not bound.infinity:
            k, n = bound.key.decode(), len(bound.key)
            out.append(f"(strlen(key) {op} {n} OR (strlen(key) = {n} AND key {op}{'=' if bound.inclusive else ''} '{k}'))")
    return f"SELECT key, ts, value FROM ({ENTRIES}) WHERE " + (" AND ".join(out) or "true")


RANGES = {
    "incl_excl": (Bound.at(500), Bound.at(1200, False)),
    "excl_incl": (Bound.at(500, False), Bound.at(1200)),
    "excl_excl": (Bound.at(99, False), Bound.at(1001, False)),
    "absent_start": (Bound.at("0500"), Bound.at("12000")),
    "neg_inf": (NEG_INF, Bound.at(77)),
    "pos_inf": (Bound.at(14000, False), POS_INF),
    "all": (NEG_INF, POS_INF),
    "single_key": (Bound.at(700), Bound.at(700)),
}
EMPTY_RANGES = {"inverted": (Bound.at(112), Bound.at(111)), "same_key_half_open": (Bound.at(111), Bound.at(111, False)), "infinities_swapped": (POS_INF, NEG_INF)}

for _name, (_start, _end) in RANGES.items():

    def _range_scan(spark, sf_dir, start=_start, end=_end):
        return shown(scan(orders(spark, sf_dir), start, end))

    QUERIES[f"range_scan_{_name}"], ORACLE_SQL[f"range_scan_{_name}"] = _range_scan, _ranges(_start, _end)

for _name, (_start, _end) in EMPTY_RANGES.items():

    def _range_empty(spark, sf_dir, start=_start, end=_end):
        return shown(scan(orders(spark, sf_dir), start, end))

    QUERIES[f"range_scan_{_name}"], ORACLE_SQL[f"range_scan_{_name}"] = _range_empty, f"SELECT key, ts, value FROM ({ENTRIES}) WHERE false"


@query(f"SELECT key, value, row_number() OVER (ORDER BY strlen(key), key) - 1 AS pos FROM ({_ranges(Bound.at(500), Bound.at(1200, False))})")
def range_scan_in_order(spark, sf_dir):
    found = scan(orders(spark, sf_dir), Bound.at(500), Bound.at(1200, False))
    return O.with_position(found, "klen", "key").select(text("key").alias("key"), text("value").alias("value"), "pos")


@query(f"SELECT key FROM ({ENTRIES})")
def project_keys(spark, sf_dir):
    return orders(spark, sf_dir).select(text("key").alias("key"))


@query(f"SELECT value, count(*) AS n FROM ({ENTRIES}) GROUP BY value")
def project_values(spark, sf_dir):
    return orders(spark, sf_dir).select(text("value").alias("value")).groupBy("value").agg(F.count("*").alias("n"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS a, CAST(c_nationkey AS VARCHAR) AS b,
  CASE WHEN strlen(CAST(c_custkey AS VARCHAR)) < strlen(CAST(c_nationkey AS VARCHAR)) THEN -1 WHEN strlen(CAST(c_custkey AS VARCHAR)) > strlen(CAST(c_nationkey AS VARCHAR)) THEN 1
       WHEN c_custkey = c_nationkey THEN 0 WHEN CAST(c_custkey AS VARCHAR) < CAST(c_nationkey AS VARCHAR) THEN -1 ELSE 1 END AS cmp FROM customer""")
def key_compare(spark, sf_dir):
    a, b = (F.col(c).cast("string").cast("binary") for c in ("c_custkey", "c_nationkey"))
    return table(spark, sf_dir, "customer").select(text(a).alias("a"), text(b).alias("b"), K.compare(a, b).alias("cmp"))


# --- Buffer -------------------------------------------------------------------------------------------------------


def _lines(spark, sf_dir) -> MemTable:
    """Line items put under their order's key, in order of line, part, supplier and price."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    key = F.col("l_orderkey").cast("string").cast("binary")
    puts = table(spark, sf_dir, "lineitem").select(key.alias("key"), F.octet_length(key).alias("klen"), F.lit(0).cast("decimal(20,0)").alias("ts"), F.col("l_partkey").cast("string").cast("binary").alias("value"), *order)
    return MemTable(spark).put(puts, *order)


@query(f"SELECT key, ts, value FROM ({ENTRIES}) WHERE key = '777'")
def point_get(spark, sf_dir):
    return shown(MemTable(spark).put(orders(spark, sf_dir)).get(777))


@query(f"SELECT key, ts, value FROM ({ENTRIES}) WHERE key = 'none'")
def point_get_missing(spark, sf_dir):
    return shown(MemTable(spark).put(orders(spark, sf_dir)).get("none"))


@query("SELECT '' AS value")
def point_get_or_empty(spark, sf_dir):
    return MemTable(spark).put(orders(spark, sf_dir)).get_or_empty("none").select(text("value").alias("value"))


FIRST_LAST = """SELECT CAST(l_orderkey AS VARCHAR) AS key, CAST(l_partkey AS VARCHAR) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber {0}, l_partkey {0}, l_suppkey {0}, l_extendedprice {0}) AS n FROM lineitem) WHERE n = 1"""


@query(FIRST_LAST.format("ASC"))
def memtable_first_write(spark, sf_dir):
    return _lines(spark, sf_dir).entries().select(text("key").alias("key"), text("value").alias("value"))


@query(FIRST_LAST.format("DESC"))
def memtable_last_write(spark, sf_dir):
    buffer = _lines(spark, sf_dir)
    buffer.policy = "last"
    return buffer.entries().select(text("key").alias("key"), text("value").alias("value"))


@query("SELECT count(DISTINCT l_orderkey) AS n_keys, CAST(sum(strlen(CAST(l_orderkey AS VARCHAR)) + strlen(CAST(l_partkey AS VARCHAR))) AS BIGINT) AS approximate_bytes, count(*) = 0 AS is_empty FROM lineitem")
def memtable_stats(spark, sf_dir):
    return _lines(spark, sf_dir).stats()


@query(f"""SELECT key, value, row_number() OVER (ORDER BY strlen(key), key) - 1 AS pos FROM (
  SELECT key, value FROM ({FIRST_LAST.format("ASC")}) WHERE (strlen(key) > 2 OR (strlen(key) = 2 AND key > '10')) AND (strlen(key) < 3 OR (strlen(key) = 3 AND key <= '160')))""")
def memtable_scan(spark, sf_dir):
    found = _lines(spark, sf_dir).scan(Bound.at(10, False), Bound.at(160))
    return O.with_position(found, "klen", "key").select(text("key").alias("key"), text("value").alias("value"), "pos")


@query(FIRST_LAST.format("ASC"))
def memtable_flush(spark, sf_dir):
    """Written as a level and read back (an extension)."""
    level = _lines(spark, sf_dir).flush(new_path(spark, "flush"), files=4)
    return level.scan(ordered=False).select(text("key").alias("key"), text("value").alias("value"))


# --- Merges -------------------------------------------------------------------------------------------------------


def _source(spark, sf_dir, every: int, name: str, low: int = 0) -> DataFrame:
    t = table(spark, sf_dir, "orders").where((F.col("o_orderkey") % every == 0) & (F.col("o_orderkey") >= low))
    return K.entries(t, "o_orderkey", F.concat(F.lit(name), F.col("o_orderstatus")), "o_custkey")


def _source_sql(every: int, name: str, low: int = 0) -> str:
    return f"SELECT CAST(o_orderkey AS VARCHAR) AS key, o_custkey AS ts, '{name}' || o_orderstatus AS value FROM orders WHERE o_orderkey % {every} = 0 AND o_orderkey >= {low}"


@query(f"WITH a AS ({_source_sql(3, 'a')}), b AS ({_source_sql(2, 'b')}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.key = b.key)")
def merge_bin(spark, sf_dir):
    return shown(M.merge_bin(_source(spark, sf_dir, 3, "a"), _source(spark, sf_dir, 2, "b")))


MERGE3 = f"""SELECT key, ts, value, src_rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY src_rank) AS n FROM (
  SELECT *, 0 AS src_rank FROM ({_source_sql(5, 'a', 100)}) UNION ALL SELECT *, 1 FROM ({_source_sql(3, 'b')}) UNION ALL SELECT *, 2 FROM ({_source_sql(2, 'c')}))) WHERE n = 1"""


def _three(spark, sf_dir) -> list[DataFrame]:
    return [_source(spark, sf_dir, 5, "a", 100), _source(spark, sf_dir, 3, "b"), _source(spark, sf_dir, 2, "c")]


@query(MERGE3)
def merge_multi(spark, sf_dir):
    merged = M.merge_multi(_three(spark, sf_dir))
    return merged.select(text("key").alias("key"), F.col("ts").cast("bigint").alias("ts"), text("value").alias("value"), "src_rank")


@query(f"SELECT key, value, row_number() OVER (ORDER BY strlen(key), key) - 1 AS pos FROM ({MERGE3})")
def merge_multi_in_order(spark, sf_dir):
    merged = O.with_position(M.merge_multi(_three(spark, sf_dir)), "klen", "key")
    return merged.select(text("key").alias("key"), text("value").alias("value"), "pos")


@query(f"SELECT key, ts, value FROM ({MERGE3}) WHERE (strlen(key) > 2 OR (strlen(key) = 2 AND key >= '50')) AND (strlen(key) < 4 OR (strlen(key) = 4 AND key < '2000'))")
def merge_bounded(spark, sf_dir):
    """Each source is cut before the merge."""
    start, end = Bound.at(50), Bound.at(2000, False)
    return shown(M.merge_multi([scan(s, start, end) for s in _three(spark, sf_dir)]))


@query("""SELECT CAST(k AS VARCHAR) AS key, CAST(v AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r, p) AS n FROM (
  SELECT l_orderkey AS k, l_partkey AS v, 0 AS r, l_linenumber * 1000000 + l_partkey AS p FROM lineitem WHERE l_linenumber > 3
  UNION ALL SELECT o_orderkey, o_custkey, 1, 0 FROM orders)) WHERE n = 1""")
def merge_in_source_duplicates(spark, sf_dir):
    """Later duplicates within a source go too."""
    t = table(spark, sf_dir, "lineitem").where("l_linenumber > 3")
    place = F.col("l_linenumber").cast("bigint") * 1000000 + F.col("l_partkey")
    key = F.col("l_orderkey").cast("string").cast("binary")
    newer = t.select(key.alias("key"), F.col("l_partkey").cast("string").cast("binary").alias("value"), place.alias("place"))
    older = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").cast("binary").alias("key"), F.col("o_custkey").cast("string").cast("binary").alias("value"), F.lit(0).cast("bigint").alias("place"))
    return M.merge_multi([newer, older], "place").select(text("key").alias("key"), text("value").alias("value"))


@query("SELECT o_orderstatus AS status, (CASE WHEN count(*) FILTER (WHERE o_orderkey % 2 = 0) > 0 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (WHERE o_orderkey % 5000 = 7) > 0 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (WHERE o_orderkey < 0) > 0 THEN 1 ELSE 0 END) AS n_active FROM orders GROUP BY o_orderstatus")
def active_sources(spark, sf_dir):
    """How many of three sources have entries of each status; the last has none."""
    t = table(spark, sf_dir, "orders")
    parts = [K.entries(t.where(w), "o_orderkey", "o_orderstatus") for w in ("o_orderkey % 2 = 0", "o_orderkey % 5000 = 7", "o_orderkey < 0")]
    out = None
    for status in sorted(r[0] for r in t.select("o_orderstatus").distinct().collect()):
        own = M.active_sources([p.where(text("value") == status) for p in parts]).select(F.lit(status).alias("status"), F.col("n_active").cast("bigint").alias("n_active"))
        out = own if out is None else out.unionByName(own)
    return out


@query(MERGE3)
def compaction(spark, sf_dir):
    """The merge as a new level, read back (an extension); the winner's rank shows in its value."""
    level = compact(_three(spark, sf_dir), new_path(spark, "compact"), files=3)
    rank = F.instr(F.lit("abc"), F.substring(text("value"), 1, 1)) - 1
    return shown(level.scan(ordered=False)).withColumn("src_rank", rank)


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE NOT (s_suppkey % 2 = 0 AND s_suppkey IN (SELECT c_custkey FROM customer))")
def insert_missing(spark, sf_dir):
    a = K.entries(table(spark, sf_dir, "customer").where("c_custkey % 2 = 0"), "c_custkey", "c_name")
    b = K.entries(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name")
    return O.insert_missing(a, b).select(text("key").alias("key"), text("value").alias("value"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def erase_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").cast("binary").alias("key"))
    return O.erase(orders(spark, sf_dir), lines).select(text("key").alias("key"))


# --- Blocks, files and lookups ------------------------------------------------------------------------------------

RANKED = f"SELECT *, row_number() OVER (ORDER BY strlen(key), key) - 1 AS pos FROM ({ENTRIES})"
BLOCK_META = f"""SELECT pos // 100 AS block, arg_min(key, pos) AS first_key, arg_max(key, pos) AS last_key, count(*) AS n_keys, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS n_bytes, CAST(max(ts) AS BIGINT) AS max_ts FROM ({RANKED}) GROUP BY pos // 100"""


def _blocks(spark, sf_dir) -> DataFrame:
    return B.fixed_blocks(orders(spark, sf_dir), 100)


@query(BLOCK_META)
def block_meta(spark, sf_dir):
    meta = B.block_meta(_blocks(spark, sf_dir))
    return meta.select("block", text("first_key").alias("first_key"), text("last_key").alias("last_key"), "n_keys", "n_bytes", F.col("max_ts").cast("bigint").alias("max_ts"))


@query(f"SELECT key, value FROM ({RANKED}) WHERE pos // 100 = 3 AND pos % 100 >= 40")
def block_scan_from(spark, sf_dir):
    own = B.entries_from(_blocks(spark, sf_dir).where("block = 3"), 40)
    return own.select(text("key").alias("key"), text("value").alias("value"))


@query(f"SELECT pos // 100 AS block, key FROM ({RANKED}) WHERE pos % 100 = 7")
def block_entry_at(spark, sf_dir):
    return B.entry_at(_blocks(spark, sf_dir), 7).select("block", text("key").alias("key"))


def _probes(spark, sf_dir) -> DataFrame:
    """Part keys, some beyond the orders' keys, some not numbers."""
    key = F.when(F.col("p_partkey") % 3 == 0, F.concat((F.col("p_partkey") * 11).cast("string"), F.lit("5"))).otherwise((F.col("p_partkey") * 7).cast("string"))
    return table(spark, sf_dir, "part").select(key.cast("binary").alias("key"), F.octet_length(key).alias("klen")).distinct()


PROBES = "SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey * 11 AS VARCHAR) || '5' ELSE CAST(p_partkey * 7 AS VARCHAR) END AS probe FROM part"
AT_MOST = "(strlen({0}) < strlen(probe) OR (strlen({0}) = strlen(probe) AND {0} <= probe))"
BELOW = "(strlen({0}) < strlen(probe) OR (strlen({0}) = strlen(probe) AND {0} < probe))"


@query(f"WITH b AS ({BLOCK_META}), p AS ({PROBES}) SELECT probe, coalesce(max(block) FILTER (WHERE {AT_MOST.format('first_key')}), 0) AS block FROM p, b GROUP BY probe")
def locate_block(spark, sf_dir):
    meta = B.block_meta(_blocks(spark, sf_dir))
    return B.locate_block(_probes(spark, sf_dir), meta).select(text("key").alias("probe"), "block")


TENTHS = "SELECT *, ntile(10) OVER (ORDER BY strlen(key), key) - 1 AS sst_id FROM ({0})"


@query(f"WITH b AS (SELECT sst_id, arg_min(key, pos) AS first_key FROM ({TENTHS.format(RANKED)}) GROUP BY sst_id), p AS ({PROBES}) SELECT probe, coalesce(max(sst_id) FILTER (WHERE {AT_MOST.format('first_key')}), 0) AS sst_id FROM p, b GROUP BY probe")
def locate_sstable(spark, sf_dir):
    meta = _tenths(spark, sf_dir)
    return B.locate_block(_probes(spark, sf_dir), meta, "sst_id").select(text("key").alias("probe"), F.col("sst_id").cast("bigint").alias("sst_id"))


def _tenths(spark, sf_dir) -> DataFrame:
    """Manifest of ten files of equal size (sampled range bounds would not be reproducible elsewhere)."""
    placed = O.with_position(orders(spark, sf_dir), "klen", "key")
    total = orders(spark, sf_dir).count()
    small, longer = divmod(total, 10)
    cut = longer * (small + 1)
    number = F.when(F.col("pos") < cut, F.floor(F.col("pos") / (small + 1))).otherwise(longer + F.floor((F.col("pos") - cut) / max(small, 1)))
    return B.block_meta(placed.withColumn("block", number)).withColumnRenamed("block", "sst_id")


@query(f"SELECT sst_id, arg_min(key, pos) AS first_key, arg_max(key, pos) AS last_key, count(*) AS num_rows, CAST(max(ts) AS BIGINT) AS max_ts FROM ({TENTHS.format(RANKED)}) GROUP BY sst_id")
def sst_manifest(spark, sf_dir):
    return _tenths(spark, sf_dir).select("sst_id", text("first_key").alias("first_key"), text("last_key").alias("last_key"), F.col("n_keys").alias("num_rows"), F.col("max_ts").cast("bigint").alias("max_ts"))


ONE_BLOCK = "SELECT CAST(s_suppkey * 5 AS VARCHAR) AS key, row_number() OVER (ORDER BY strlen(CAST(s_suppkey * 5 AS VARCHAR)), CAST(s_suppkey * 5 AS VARCHAR)) - 1 AS idx FROM supplier"


def _one_block(spark, sf_dir) -> DataFrame:
    rows = K.entries(table(spark, sf_dir, "supplier"), F.col("s_suppkey") * 5, "s_name")
    return O.with_position(rows, "klen", "key", name="idx")


def _locate(spark, sf_dir, **options) -> DataFrame:
    return B.locate_key(_probes(spark, sf_dir), _one_block(spark, sf_dir), **options).select(text("key").alias("probe"), "idx")


@query(f"WITH b AS ({ONE_BLOCK}), p AS ({PROBES}) SELECT probe, coalesce(max(idx) FILTER (WHERE {AT_MOST.format('key')}), 0) AS idx FROM p, b GROUP BY probe")
def locate_key_start(spark, sf_dir):
    return _locate(spark, sf_dir)


@query(f"WITH b AS ({ONE_BLOCK}), p AS ({PROBES}) SELECT probe, count(*) FILTER (WHERE {AT_MOST.format('key')}) AS idx FROM p, b GROUP BY probe")
def locate_key_end(spark, sf_dir):
    return _locate(spark, sf_dir, start=False)


@query(f"WITH b AS ({ONE_BLOCK}), p AS ({PROBES}) SELECT probe, count(*) FILTER (WHERE {BELOW.format('key')}) AS idx FROM p, b GROUP BY probe")
def locate_key_end_exclusive(spark, sf_dir):
    return _locate(spark, sf_dir, start=False, inclusive=False)


@query(f"""WITH k AS ({ONE_BLOCK}), p AS ({PROBES}) SELECT probe, arg_max(key, idx) FILTER (WHERE {AT_MOST.format('key')}) AS at_most, arg_max(key, idx) FILTER (WHERE {BELOW.format('key')}) AS below,
  arg_min(key, idx) FILTER (WHERE NOT {BELOW.format('key')}) AS at_least, arg_min(key, idx) FILTER (WHERE NOT {AT_MOST.format('key')}) AS above FROM p, k GROUP BY probe""")
def nearest_keys(spark, sf_dir):
    """Floor and ceiling lookups, with and without equality."""
    index = _one_block(spark, sf_dir).select("klen", "key", text("key").alias("found"))
    out = O.nearest(_probes(spark, sf_dir), index, "found", {c: c for c in ("at_most", "below", "at_least", "above")})
    return out.select(text("key").alias("probe"), "at_most", "below", "at_least", "above")


@query(f"SELECT key, lead(key) OVER (ORDER BY strlen(key), key) AS next, lag(key) OVER (ORDER BY strlen(key), key) AS previous FROM ({ENTRIES})")
def next_and_previous(spark, sf_dir):
    found = O.adjacent(orders(spark, sf_dir).select("klen", "key"))
    return found.select(text("key").alias("key"), text("next").alias("next"), text("previous").alias("previous"))


@query(f"SELECT arg_min(key, pos) AS first_key, arg_max(key, pos) AS last_key FROM ({RANKED})")
def first_and_last(spark, sf_dir):
    return O.ends(orders(spark, sf_dir)).select(text("first_key").alias("first_key"), text("last_key").alias("last_key"))


@query("""WITH RECURSIVE o AS (SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS value, row_number() OVER (ORDER BY strlen(CAST(s_suppkey AS VARCHAR)), CAST(s_suppkey AS VARCHAR)) AS r FROM supplier),
ov AS (SELECT a.r AS ar, b.r AS br, CAST(coalesce(list_position(list_transform(range(1, least(strlen(a.key), strlen(b.key)) + 1), lambda i: substr(a.key, i, 1) = substr(b.key, i, 1)), false) - 1, least(strlen(a.key), strlen(b.key))) AS BIGINT) AS n FROM o a, o b WHERE a.r <= b.r),
f AS (SELECT CAST(1 AS BIGINT) AS r, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS idx, CAST(1 AS BIGINT) AS first_r, 18 + strlen(key) + strlen(value) AS size FROM o WHERE r = 1
  UNION ALL
  SELECT o.r, CASE WHEN f.size > 256 THEN f.block + 1 ELSE f.block END, CASE WHEN f.size > 256 THEN 0 ELSE f.idx + 1 END, CASE WHEN f.size > 256 THEN o.r ELSE f.first_r END,
    CASE WHEN f.size > 256 THEN 18 + strlen(o.key) + strlen(o.value) ELSE f.size + 16 + strlen(o.key) - ov.n + strlen(o.value) END
  FROM f JOIN o ON o.r = f.r + 1 JOIN ov ON ov.ar = f.first_r AND ov.br = o.r)
SELECT key, block, idx FROM f JOIN o USING (r)""")
def packed_blocks(spark, sf_dir):
    """Blocks cut by their byte budget, in one file."""
    rows = K.entries(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name")
    return B.packed_blocks(rows, 256, files=1).select(text("key").alias("key"), "block", "idx")


@query(f"SELECT key, ts, value FROM ({ENTRIES}) WHERE (strlen(key) > 3 OR (strlen(key) = 3 AND key > '500')) AND (strlen(key) < 4 OR (strlen(key) = 4 AND key <= '5001'))")
def level_scan(spark, sf_dir):
    """Written as sorted files; the manifest picks those to open."""
    level = write_level(orders(spark, sf_dir), new_path(spark, "level"), files=8)
    return shown(level.scan(Bound.at(500, False), Bound.at(5001), ordered=False))


@query(f"SELECT key, ts, value FROM ({ENTRIES}) WHERE key = '1234'")
def level_get(spark, sf_dir):
    return shown(write_level(orders(spark, sf_dir), new_path(spark, "level"), files=8).get(1234))


@query(f"SELECT key, ts, value FROM ({ENTRIES}) WHERE CAST(key AS BIGINT) % 7 = 0")
def level_get_many(spark, sf_dir):
    """Of many keys, half of which the level's filter drops."""
    number = F.col("o_orderkey").cast("string")
    keys = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.explode(F.array(number, F.concat(F.lit("x"), number))).alias("k"))
    level = write_level(orders(spark, sf_dir), new_path(spark, "level"), files=8, with_filter=True)
    return shown(level.get_many(keys.select(F.octet_length("k").alias("klen"), F.col("k").cast("binary").alias("key"))))


@query(f"SELECT key, ts, value FROM ({ENTRIES})")
def sstable_scan(spark, sf_dir):
    """Every file of a level read alone, with page checksums compared."""
    level = write_level(orders(spark, sf_dir), new_path(spark, "level"), files=4, verify=True)
    out = level.sstable(0)
    for i in range(1, level.count()):
        out = out.unionByName(level.sstable(i))
    return shown(out)


def _store(spark, sf_dir) -> Store:
    """Two levels, one merged from two sources, and a buffer above them."""
    newer, middle, older = _three(spark, sf_dir)
    low = compact([middle, older], new_path(spark, "store"), files=3)
    high = write_level(newer, new_path(spark, "store"), files=2)
    return Store(spark, MemTable(spark).put(_source(spark, sf_dir, 7, "m")), [high, low])


STORE = f"""SELECT key, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r) AS n FROM (
  SELECT *, 0 AS r FROM ({_source_sql(7, 'm')}) UNION ALL SELECT key, ts, value, 1 + src_rank FROM ({MERGE3}))) WHERE n = 1"""


@query(STORE)
def store_scan(spark, sf_dir):
    """Buffer and levels, newest first; one of the levels is a merge of merges."""
    return shown(_store(spark, sf_dir).scan(ordered=False))


@query(f"SELECT key, ts, value FROM ({STORE}) WHERE (strlen(key) > 2 OR (strlen(key) = 2 AND key > '30')) AND (strlen(key) < 4 OR (strlen(key) = 4 AND key <= '3000'))")
def store_scan_bounded(spark, sf_dir):
    return shown(_store(spark, sf_dir).scan(Bound.at(30, False), Bound.at(3000), ordered=False))


@query(f"SELECT key, ts, value FROM ({STORE}) WHERE key IN ('210', '225', '18')")
def store_get(spark, sf_dir):
    """Keys that the buffer, the upper and the lower level answer, and one that none has."""
    store = _store(spark, sf_dir)
    out = store.get(210)
    for key in (225, 18, "none"):
        out = out.unionByName(store.get(key))
    return shown(out)


@query(f"SELECT key, ts, value FROM ({STORE}) WHERE CAST(key AS BIGINT) % 11 = 0")
def store_get_many(spark, sf_dir):
    key = F.col("o_orderkey").cast("string").cast("binary")
    keys = table(spark, sf_dir, "orders").where("o_orderkey % 11 = 0").select(F.octet_length(key).alias("klen"), key.alias("key"))
    return shown(_store(spark, sf_dir).get_many(keys))


@query(MERGE3.replace("key, ts, value, src_rank FROM (", "key, ts, value FROM (", 1))
def merge_of_merges(spark, sf_dir):
    """Newest source wins, whichever way merges are put together."""
    a, b, c = _three(spark, sf_dir)
    return shown(M.merge_bin(a, M.merge_multi([b, c]).drop("src_rank")))


@query(f"SELECT count(*) AS n_entries, CAST(sum(strlen(key) + strlen(value) + 16) + 2 AS BIGINT) AS estimated_bytes FROM ({ENTRIES})")
def level_estimated_size(spark, sf_dir):
    """Before it is written."""
    return estimated_size(orders(spark, sf_dir))


@query("SELECT CAST(count(*) AS BIGINT) AS located, CAST(0 AS BIGINT) AS elsewhere, CAST(6 AS BIGINT) AS n_files FROM orders")
def level_locate(spark, sf_dir):
    """The file of each key by the manifest of files that were written, against how many keys each file has."""
    level = write_level(orders(spark, sf_dir), new_path(spark, "level"), files=6)
    found = level.locate_sstable(orders(spark, sf_dir).select("klen", "key")).groupBy("sst_id").agg(F.count("*").alias("n"))
    both = level.manifest.select("sst_id", "num_rows").join(found, "sst_id", "full")
    apart = F.abs(F.coalesce("num_rows", F.lit(0)) - F.coalesce("n", F.lit(0)))
    return both.agg(F.sum("n").alias("located"), F.sum(apart).alias("elsewhere"), F.count("num_rows").alias("n_files"))


@query(f"SELECT key, ts, value FROM ({ENTRIES}) WHERE (strlen(key) > 3 OR (strlen(key) = 3 AND key >= '700')) AND (strlen(key) < 4 OR (strlen(key) = 4 AND key < '2500'))")
def level_pinned(spark, sf_dir):
    """A scan that files kept in memory answer."""
    level = write_level(orders(spark, sf_dir), new_path(spark, "level"), files=8).pin(Bound.at(100), Bound.at(4000))
    return shown(level.scan(Bound.at(700), Bound.at(2500, False), ordered=False))


@query("SELECT CAST(4 AS BIGINT) AS n_files, true AS blocks_add_up, true AS blocks_in_each")
def level_blocks(spark, sf_dir):
    """Sizes of files and how many blocks they take up."""
    level = write_level(orders(spark, sf_dir), new_path(spark, "level"), files=4, block_bytes=4096)
    b = F.col("n_blocks")
    fits = (b * 4096 >= F.col("file_bytes")) & ((b - 1) * 4096 < F.col("file_bytes"))
    return level.manifest.agg(F.count("*").alias("n_files"), F.bool_and(fits).alias("blocks_add_up"), F.bool_and(b > 1).alias("blocks_in_each"))


@query(f"SELECT CAST(8 AS BIGINT) AS n_files, CAST(count(*) AS BIGINT) AS num_rows, CAST(max(ts) AS BIGINT) AS max_ts, false AS overlapping FROM ({ENTRIES})")
def level_files(spark, sf_dir):
    path = new_path(spark, "level")
    level = write_level(orders(spark, sf_dir), path, files=8)
    joined = Level.assemble(spark, [Level(spark, describe(spark, path, files=8))])
    sums = joined.manifest.agg(F.count("*").alias("n_files"), F.sum("num_rows").alias("num_rows"), F.max("max_ts").cast("bigint").alias("max_ts"))
    return sums.withColumn("overlapping", F.lit(not level.overlaps().isEmpty()))


# --- Scalars ------------------------------------------------------------------------------------------------------

OVERLAP = "CAST(coalesce(list_position(list_transform(range(1, least(strlen(key), strlen(first_key)) + 1), lambda i: substr(key, i, 1) = substr(first_key, i, 1)), false) - 1, least(strlen(key), strlen(first_key))) AS INTEGER)"
WITH_FIRST = f"SELECT key, first_value(key) OVER (PARTITION BY pos // 100 ORDER BY pos) AS first_key FROM ({RANKED})"


def _with_first(spark, sf_dir) -> DataFrame:
    own = _blocks(spark, sf_dir)
    first = B.block_meta(own).select("block", "first_key")
    return B.prefix_compressed(own.join(first, "block"), K.overlap("key", "first_key"))


@query(f"SELECT key, first_key, {OVERLAP} AS overlap FROM ({WITH_FIRST})")
def prefix_overlap(spark, sf_dir):
    return _with_first(spark, sf_dir).select(text("key").alias("key"), text("first_key").alias("first_key"), "overlap")


@query(f"SELECT key, key AS spliced, substr(first_key, 1, 2) || substr(key, 1 + {OVERLAP}) AS other, substr(key, 1 + {OVERLAP}) AS rest FROM ({WITH_FIRST})")
def key_splice(spark, sf_dir):
    own = _with_first(spark, sf_dir)
    return own.select(text("key").alias("key"), text(K.splice("first_key", "overlap", "rest")).alias("spliced"), text(K.splice("first_key", F.lit(2), "rest")).alias("other"), text("rest").alias("rest"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE '#' || n_name || '#' END AS printed, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE strlen(n_name) + 2 END AS size, n_nationkey % 5 = 0 AS empty FROM nation")
def key_functions(spark, sf_dir):
    nul = F.unhex(F.lit("00"))
    key = F.when(F.col("n_nationkey") % 5 == 0, F.unhex(F.lit(""))).otherwise(F.concat(nul, F.col("n_name").cast("binary"), nul))
    return table(spark, sf_dir, "nation").select("n_nationkey", K.printable(key).alias("printed"), K.size(key).cast("bigint").alias("size"), K.is_empty(key).alias("empty"))


@query("SELECT o_orderkey, o_orderkey AS decoded, CAST(4 AS BIGINT) AS n_bytes, printf('%02X%02X%02X%02X', o_orderkey & 255, (o_orderkey >> 8) & 255, (o_orderkey >> 16) & 255, (o_orderkey >> 24) & 255) AS encoded FROM orders")
def little_endian(spark, sf_dir):
    code = K.little_endian("o_orderkey", 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", K.from_little_endian(code, 0, 4).alias("decoded"), K.size(code).cast("bigint").alias("n_bytes"), F.hex(code).alias("encoded"))


#: Reflected CRC-32, bit by bit, by a list fold.
CRC_SQL = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen(t) + 1), lambda i: CAST(ascii(substr(t, i, 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""


@query(f"SELECT t, printf('%08X', xor({CRC_SQL}, 4294967295)) AS crc FROM (SELECT n_name AS t FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT '123456789')")
def checksum(spark, sf_dir):
    """Of names, and of the usual check text."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("t")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("t")))
    every = names.unionByName(spark.range(1).select(F.lit("123456789").alias("t")))
    return every.select("t", F.lpad(F.hex(K.checksum(F.col("t").cast("binary"))), 8, "0").alias("crc"))


@query("SELECT n_nationkey, substr(n_name, 1, 2) || '--' || substr(n_name, 5) AS inside, substr(n_name, 1, 3) || '0123456789abcdefghijklmnopqrstuvwxyz' AS over_the_end FROM nation")
def key_overwrite(spark, sf_dir):
    """Bytes replaced in place; what goes over the end is appended."""
    name, long = F.col("n_name").cast("binary"), F.lit("0123456789abcdefghijklmnopqrstuvwxyz").cast("binary")
    return table(spark, sf_dir, "nation").select("n_nationkey", text(K.overwrite(name, 2, F.lit("--").cast("binary"))).alias("inside"), text(K.overwrite(name, 3, long)).alias("over_the_end"))


# --- Bloom filters ------------------------------------------------------------------------------------------------


@query("""SELECT elements, fpp, CAST(k AS BIGINT) AS n_hashes, CAST(ceil(floor(m) / 8) * 8 AS BIGINT) AS table_size FROM (
  SELECT elements, fpp, min(-k * elements / ln(1 - pow(fpp, 1.0 / k))) AS m, arg_min(k, -k * elements / ln(1 - pow(fpp, 1.0 / k))) AS k
  FROM (SELECT CAST(s_suppkey * 64 + 64 AS BIGINT) AS elements, CASE WHEN s_suppkey % 2 = 0 THEN 0.01::DOUBLE ELSE 0.001::DOUBLE END AS fpp FROM supplier), (SELECT unnest(range(1, 1000)) AS k) GROUP BY elements, fpp)""")
def bloom_parameters(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 64 + 64).cast("bigint").alias("elements"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(0.01)).otherwise(F.lit(0.001)).alias("fpp"))
    return parameter_table(wanted)


def _even(spark, sf_dir) -> tuple[DataFrame, Bloom]:
    rows = orders(spark, sf_dir).select("key", (F.col("key").cast("string").cast("bigint") % 2 == 0).alias("member"))
    return rows, Bloom.build(rows.where("member"), Parameters(rows.count(), 0.01))


def _and_third(spark, sf_dir) -> tuple[DataFrame, Bloom, Bloom]:
    """Keys as numbers, and filters of those divisible by 2 and by 3."""
    rows = orders(spark, sf_dir).select("key", F.col("key").cast("string").cast("bigint").alias("k"))
    p = Parameters(rows.count(), 0.01)
    return rows, Bloom.build(rows.where("k % 2 = 0"), p), Bloom.build(rows.where("k % 3 = 0"), p)


@query("SELECT CAST(count(*) AS BIGINT) AS members, CAST(count(*) AS BIGINT) AS found, true AS few_false FROM orders WHERE o_orderkey % 2 = 0")
def bloom_probe(spark, sf_dir):
    """No member is missed, and at most 1 % of all probes are false positives."""
    rows, bloom = _even(spark, sf_dir)
    hit = bloom.contains(rows)
    found = F.count(F.when(F.col("member") & F.col("maybe"), 1))
    return hit.agg(F.count(F.when(F.col("member"), 1)).alias("members"), found.alias("found"), (F.count(F.when(~F.col("member") & F.col("maybe"), 1)) <= 0.01 * F.count("*")).alias("few_false"))


SETS = {"and": "k % 6 = 0", "or": "k % 2 = 0 OR k % 3 = 0", "folded": "k % 2 = 0"}


@query("WITH o AS (SELECT o_orderkey AS k FROM orders) " + " UNION ALL ".join(f"SELECT '{name}' AS operation, CAST(count(*) FILTER (WHERE {own}) AS BIGINT) AS members, CAST(count(*) FILTER (WHERE {own}) AS BIGINT) AS found, true AS few_false FROM o" for name, own in SETS.items()))
def bloom_set_operations(spark, sf_dir):
    """Members of the intersection, union and folded filter, those found, and whether few others are."""
    rows, even, third = _and_third(spark, sf_dir)
    made = {"and": even & third, "or": even | third, "folded": even.folded(even.table_size // 2) if even.buckets % 2 == 0 else even}
    out = None
    for name, own in SETS.items():
        member = F.expr(own)
        hit = made[name].contains(rows).agg(F.lit(name).alias("operation"), F.count(F.when(member, 1)).alias("members"), F.count(F.when(member & F.col("maybe"), 1)).alias("found"), (F.count(F.when(~member & F.col("maybe"), 1)) <= 0.1 * F.count("*")).alias("few_false"))
        out = hit if out is None else out.unionByName(hit)
    return out


@query("SELECT CAST(0 AS BIGINT) AS itself, CAST(0 AS BIGINT) AS other_way, CAST(0 AS BIGINT) AS back, CAST(count(*) AS BIGINT) AS still_found FROM orders WHERE o_orderkey % 2 = 0")
def bloom_difference(spark, sf_dir):
    """Bits of a ^ a, of (a ^ b) ^ (b ^ a), of (a ^ b) ^ b ^ a, and members of a that are in (a ^ b) ^ b."""
    rows, a, b = _and_third(spark, sf_dir)
    either = a ^ b
    left = [x.set_bits().first()[0] for x in (a ^ a, either ^ (b ^ a), (either ^ b) ^ a)]
    found = (either ^ b).contains(rows.where("k % 2 = 0")).agg(F.count(F.when(F.col("maybe"), 1)).alias("still_found"))
    return found.select(*(F.lit(n).cast("bigint").alias(name) for n, name in zip(left, ("itself", "other_way", "back"), strict=True)), "still_found")


@query("SELECT CAST(count(*) FILTER (WHERE o_orderkey % 2 = 0) AS BIGINT) AS inserted, true AS same, false AS same_as_other, CAST(0 AS BIGINT) AS bits_when_cleared, CAST(count(*) FILTER (WHERE o_orderkey % 2 = 0) AS BIGINT) AS found FROM orders")
def bloom_round_trip(spark, sf_dir):
    """Written and read again."""
    rows, a, b = _and_third(spark, sf_dir)
    path = new_path(spark, "bloom")
    a.write(path)
    again = Bloom.read(spark, path)
    found = again.contains(rows.where("k % 2 = 0")).agg(F.count(F.when(F.col("maybe"), 1)).alias("found"))
    facts = {"inserted": again.inserted, "same": again.same_as(a), "same_as_other": again.same_as(b), "bits_when_cleared": again.cleared().set_bits().first()[0]}
    return found.select(*(F.lit(v).cast("boolean" if isinstance(v, bool) else "bigint").alias(k) for k, v in facts.items()), "found")


# --- Streaming (an extension) -------------------------------------------------------------------------------------


@query("""SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def streaming_ingest(spark, sf_dir):
    """Events as a stream of one batch; the newest event of each user."""
    from ..streaming.ingest import ingest, merged

    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    root = new_path(spark, "ingest")
    as_entries = lambda df: df.select(F.col("user_id").cast("string").cast("binary").alias("key"), F.octet_length(F.col("user_id").cast("string")).alias("klen"), F.col("event_id").cast("decimal(20,0)").alias("ts"), F.col("event_type").cast("binary").alias("value"), "__order")
    run = ingest(stream, as_entries, root, "event_id")
    run.awaitTermination()
    levels = run.lastProgress["batchId"] + 1 if run.lastProgress else 1
    return merged(spark, root, levels).select(text("key").alias("key"), text("value").alias("value"))
