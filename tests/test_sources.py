import random

import pytest
from pyspark.sql import functions as F

from sortilex.functions import keys as K
from sortilex.operators.bounds import NEG_INF, POS_INF, Bound
from sortilex.sources.memtable import MemTable
from sortilex.sources.runs import MANIFEST, Level, compact, describe, estimated_size, write_level
from sortilex.sources.store import Store

at = Bound.at


def numbers(df):
    return [int(r.key) for r in df.collect()]


@pytest.fixture(scope="module")
def buffer(spark):
    return MemTable(spark).put_values([(i, 2 * i) for i in range(1000, -1, -2)])


@pytest.mark.parametrize(
    ("start", "end", "want"),
    [
        (POS_INF, NEG_INF, []),
        (POS_INF, at(111, False), []),
        (POS_INF, at(111), []),
        (at(112, False), at(111), []),
        (at(111), at(111, False), []),
        (at(1003), at(11111, False), []),
        (NEG_INF, POS_INF, list(range(0, 1001, 2))),
        (at(10, False), POS_INF, list(range(12, 1001, 2))),
        (at(10, False), at(16, False), [12, 14]),
        (at(998), at(11111, False), [998, 1000]),
        (at(11), POS_INF, list(range(12, 1001, 2))),
    ],
)
def test_buffer_ranges(buffer, start, end, want):
    assert numbers(buffer.scan(start, end)) == want


def test_buffer_get_and_stats(buffer, spark):
    assert bytes(buffer.get(500).first().value) == b"1000" and buffer.get(501).isEmpty()
    assert bytes(buffer.get_or_empty(501).first().value) == b"" and bytes(buffer.get_or_empty(0).first().value) == b"0"
    again = MemTable(spark).put_values([(1, "a"), (2, "b"), (1, "c")]).put_values([(2, "d")])
    assert [bytes(r.value) for r in again.scan().collect()] == [b"a", b"b"]
    assert again.stats().first() == (2, 8, False) and MemTable(spark).stats().first() == (0, 0, True)
    again.policy = "last"
    assert [bytes(r.value) for r in again.scan().collect()] == [b"c", b"d"]
    assert MemTable(spark).scan().isEmpty()


@pytest.fixture(scope="module")
def level(spark, tmp_path_factory):
    rows = spark.range(1, 1001).select((F.col("id") * 5).alias("k"))
    return write_level(K.entries(rows, "k", F.col("k") * 2, F.col("k")), f"{tmp_path_factory.mktemp('level')}/run", files=10)


ALL = list(range(5, 5001, 5))


@pytest.mark.parametrize(
    ("start", "end", "want"),
    [
        (NEG_INF, POS_INF, ALL),
        (at(2), at(5001), ALL),
        (at(2, False), at(5001, False), ALL),
        (at(5), at(5000), ALL),
        (at(5, False), at(5000, False), ALL[1:-1]),
        (at(500, False), at(505, False), []),
        (at(500, False), at(5001), ALL[100:]),
        (at(500), at(500), [500]),
        (at(500, False), at(500), []),
        (at(500), at(500, False), []),
        (NEG_INF, NEG_INF, []),
        (POS_INF, POS_INF, []),
        (POS_INF, at(500), []),
        (at(500), NEG_INF, []),
    ],
)
def test_level_ranges(level, start, end, want):
    assert numbers(level.scan(start, end)) == want


def test_level_files(spark, level, tmp_path):
    assert level.count() == 10 and level.overlaps().isEmpty()
    assert len(level.files_for(at(500), at(500))) == 1 and level.files_for(at(6000), POS_INF) == []
    assert numbers(level.get(3000)) == [3000] and level.get(3001).isEmpty()
    total = level.manifest.agg(F.sum("num_rows"), F.max("max_ts")).first()
    assert (total[0], int(total[1])) == (1000, 5000)
    firsts = [int(r[0]) for r in level.manifest.orderBy("sst_id").select("first_key").collect()]
    probes = [2, 5, 500, *firsts, *(f - 1 for f in firsts[1:]), 5000, 5001]
    df = spark.createDataFrame([(bytearray(str(p).encode()), len(str(p))) for p in probes], "key binary, klen int")
    for r in level.locate_sstable(df).collect():
        assert r.sst_id == max((i for i, f in enumerate(firsts) if f <= int(r.key)), default=0)
    assert sum(level.sstable(i).count() for i in range(10)) == 1000
    other = write_level(K.entries(spark.range(7000, 7100), "id", "id"), f"{tmp_path}/other", files=2)
    assert numbers(Level.assemble(spark, [other, level]).scan(at(4990), POS_INF)) == [4990, 4995, 5000, *range(7000, 7100)]
    with pytest.raises(ValueError):
        Level.assemble(spark, [level, Level(spark, level.manifest)])
    assert describe(spark, f"{tmp_path}/other").count() == 2


def test_merges_against_model(spark, tmp_path):
    rng = random.Random(0)
    picks = [rng.sample(range(10_000), n) for n in (700, 500, 600, 700)]
    model = {}
    for i, own in reversed(list(enumerate(picks))):
        model |= dict.fromkeys(own, i)
    frames = [K.entries(spark.createDataFrame([(k,) for k in own], "k bigint"), "k", F.lit(i)) for i, own in enumerate(picks)]
    got = [(int(r.key), int(r.value)) for r in compact(frames, f"{tmp_path}/c", files=3).scan().collect()]
    assert got == sorted(model.items())


def test_store_reads_the_newest(spark, tmp_path):
    """Buffer over three levels, against a dictionary; then flushed and compacted."""
    rng = random.Random(1)
    picks = [rng.sample(range(10_000), n) for n in (700, 500, 600, 700)]
    model = {}
    for i, own in reversed(list(enumerate(picks))):
        model |= dict.fromkeys(own, i)
    frames = [K.entries(spark.createDataFrame([(k,) for k in own], "k bigint"), "k", F.lit(i)) for i, own in enumerate(picks)]
    store = Store(spark, MemTable(spark).put(frames[0]), [write_level(f, f"{tmp_path}/{i}", files=3, with_filter=i == 1) for i, f in enumerate(frames) if i])
    found = lambda df: [(int(r.key), int(r.value)) for r in df.collect()]
    ask = spark.createDataFrame([(str(k),) for k in range(0, 11_000, 3)], "k string").select(F.octet_length("k").alias("klen"), F.col("k").cast("binary").alias("key"))
    for step in (lambda: None, lambda: store.flush(f"{tmp_path}/flushed"), lambda: store.compact(f"{tmp_path}/all", files=2)):
        step()
        assert found(store.scan()) == sorted(model.items())
        assert found(store.scan(at(500), at(1200, False))) == sorted((k, v) for k, v in model.items() if 500 <= k < 1200)
        for k in (*picks[3][:2], picks[0][0], 10_001):
            assert found(store.get(k)) == [(k, model.get(k))] * (k in model)
        assert sorted(found(store.get_many(ask))) == sorted((k, v) for k, v in model.items() if k % 3 == 0)
    assert len(store.levels) == 1 and Store(spark).scan().isEmpty() and Store(spark).get(1).isEmpty()
    assert Store(spark).compact(f"{tmp_path}/none").scan().isEmpty()


def test_compaction_deals_rows_out_once(spark):
    from sortilex.operators.merge import newest, ranked
    from sortilex.sources.runs import arranged

    a, b = (K.entries(spark.range(n), "id", "id") for n in (100, 200))
    plan = newest(arranged(ranked([a, b]), 3)).sortWithinPartitions("klen", "key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning" not in plan


def test_damage_is_noticed(spark, tmp_path):
    rows = K.entries(spark.range(5000), "id", F.sha2(F.col("id").cast("string"), 256))
    path = f"{tmp_path}/run"
    write_level(rows, path, files=1)
    assert Level.open(spark, path, verify=True).scan(ordered=False).count() == 5000
    file = next((tmp_path / "run").glob("part-*.parquet"))
    (tmp_path / "run" / f".{file.name}.crc").unlink()  # the local file system's own check
    raw = bytearray(file.read_bytes())
    raw[5000] ^= 0x55  # in the first pages
    file.write_bytes(raw)
    with pytest.raises(Exception, match="(?i)crc|checksum"):
        Level.open(spark, path, verify=True).scan(ordered=False).agg(F.sum(F.crc32("value")), F.sum(F.crc32("key"))).collect()
    manifest = spark.read.parquet(f"{path}/{MANIFEST}")
    manifest.withColumn("num_rows", F.lit(7).cast("bigint")).write.parquet(f"{tmp_path}/bad/{MANIFEST}")
    manifest.limit(0).write.parquet(f"{tmp_path}/short/{MANIFEST}")
    manifest.withColumn("n_files", F.lit(2).cast("bigint")).write.parquet(f"{tmp_path}/lost/{MANIFEST}")
    for name in ("bad", "lost"):
        with pytest.raises(ValueError, match="damaged"):
            Level.open(spark, f"{tmp_path}/{name}")
    with pytest.raises(Exception, match="(?i)not.*exist|PATH_NOT_FOUND"):
        Level.open(spark, f"{tmp_path}/missing")


def test_small_blocks_make_no_row_groups(spark, tmp_path):
    """Each row group costs its writer a Bloom filter until the file ends, so their number can't follow the blocks."""
    import pyarrow.parquet as pq

    level = write_level(K.entries(spark.range(20_000), "id", F.sha2(F.col("id").cast("string"), 256)), f"{tmp_path}/run", files=2, block_bytes=4096)
    assert all(pq.ParquetFile(f).num_row_groups == 1 for f in (tmp_path / "run").glob("part-*.parquet"))
    assert all(r.n_blocks == -(-r.file_bytes // 4096) > 100 for r in level.manifest.collect())


def test_large_files_come_in_parts(spark, tmp_path, monkeypatch):
    """What a task sorts has a bound, while a level keeps its number of files, their order and its entries."""
    import pyarrow.parquet as pq

    monkeypatch.setattr("sortilex.sources.runs.SMALL_PLAN", 0)
    monkeypatch.setattr("sortilex.sources.runs.PART_BYTES", 64 << 10)
    low, high = (K.entries(spark.range(0, n, step), "id", F.lit(i)) for i, (n, step) in enumerate(((9000, 3), (9000, 1))))
    want = [(k, int(k % 3 > 0)) for k in range(9000)]
    for name, level in (("one", write_level(high.withColumn("value", F.when(F.col("key").cast("string").cast("int") % 3 > 0, F.lit(b"1")).otherwise(F.lit(b"0"))), f"{tmp_path}/one", files=3)), ("two", compact([low, high], f"{tmp_path}/two", files=3))):
        files = list((tmp_path / name).glob("part-*.parquet"))
        assert len(files) > 12 and max(pq.ParquetFile(f).metadata.num_rows for f in files) < 2000
        assert level.count() == 3 and sum(len(r.paths) for r in level.manifest.collect()) == len(files)
        own = [(int(r.key), int(r.value)) for i in range(3) for r in level.sstable(i).collect()]
        assert own == want and [(int(r.key), int(r.value)) for r in level.scan().collect()] == want
        assert numbers(level.get(4321)) == [4321] and numbers(level.scan(at(4000), at(4100, False))) == list(range(4000, 4100))
        assert level.overlaps().isEmpty() and describe(spark, f"{tmp_path}/{name}").count() == len(files)
        assert Level.open(spark, f"{tmp_path}/{name}").manifest.agg(F.sum("num_rows")).first()[0] == 9000


def test_manifest_sorts_no_rows(spark, level):
    """First and last keys of files come from an aggregation without a sort of all their rows."""
    path = level.manifest.first().paths[0].rsplit("/", 1)[0]
    for asked in (describe(spark, path), describe(spark, path).select("num_rows")):
        plan = asked._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "ObjectHashAggregate" in plan
    same = [c for c in level.manifest.columns if c not in ("level_id", "sst_id")]
    assert sorted(map(str, describe(spark, path).select(same).collect())) == sorted(map(str, level.manifest.select(same).collect()))


def test_pinned_files(spark, level):
    before = numbers(level.scan(at(100), at(900)))
    level.pin(at(400), at(600))
    assert numbers(level.scan(at(450), at(500))) == [k for k in before if 450 <= k <= 500] and numbers(level.get(455)) == [455]
    assert numbers(level.scan(at(100), at(900))) == before and sum(level.sstable(i).count() for i in range(10)) == 1000
    level.release()
    size = estimated_size(level.scan(ordered=False)).first()
    assert size.n_entries == 1000 and size.estimated_bytes > 16_000
    assert all(r.n_blocks == 1 for r in level.manifest.collect())
