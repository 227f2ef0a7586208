import random
import time

import pytest
from pyspark.sql import functions as F

from sortilex.functions import keys as K
from sortilex.operators import blocks as B
from sortilex.operators import merge as M
from sortilex.operators import ordered as O
from sortilex.operators.bloom import Bloom, Parameters


def frame(spark, pairs):
    return K.entries(spark.createDataFrame(pairs, "k string, v string"), "k", "v")


def pairs(df):
    return sorted(((r.key.decode(), r.value.decode()) for r in df.collect()), key=lambda p: (len(p[0]), p[0]))


def test_merge_bin(spark):
    rng = random.Random(0)
    a, b = {}, {}
    for i in range(512):
        side = rng.randrange(3)
        if side != 1:
            a[str(3 * i)] = str(6 * i)
        if side != 0:
            b[str(3 * i)] = str(9 * i if side == 2 else 6 * i)
    want = sorted((b | a).items(), key=lambda p: (len(p[0]), p[0]))
    for limit in (None, 10_000, 1):
        assert pairs(M.merge_bin(frame(spark, list(a.items())), frame(spark, list(b.items())), limit)) == want
    plan = M.merge_bin(frame(spark, list(a.items())), frame(spark, list(b.items())), 10_000)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_merge_multi(spark):
    a, b, c = [("1", "a"), ("30", "a")], [("2", "b"), ("30", "b"), ("1", "b")], [("30", "c"), ("4", "c")]
    merged = M.merge_multi([frame(spark, x) for x in (a, b, c)])
    assert pairs(merged) == [("1", "a"), ("2", "b"), ("4", "c"), ("30", "a")]
    assert merged._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    empty = frame(spark, a).limit(0)
    assert M.merge_multi([empty, empty]).isEmpty() and M.active_sources([empty, frame(spark, a), empty]).first()[0] == 1


LOCATE = [(2, 0, None, None, None), (5, 0, 1, 0, 0), (10, 1, 2, 1, 1), (9, 0, 1, 0, 1), (11, 1, 2, 1, 2), (50, 9, 10, 9, 9), (51, 9, 10, 9, 10)]


@pytest.mark.parametrize(("options", "column"), [({}, 1), ({"start": False}, 2), ({"inclusive": False}, 3), ({"start": False, "inclusive": False}, 4)])
def test_locate_key(spark, options, column):
    block = O.with_position(frame(spark, [(str(5 * i), str(i)) for i in range(1, 11)]), "klen", "key", name="idx")
    probes = spark.createDataFrame([(bytearray(str(r[0]).encode()), len(str(r[0]))) for r in LOCATE], "key binary, klen int")
    got = {int(r.key): r.idx for r in B.locate_key(probes, block, **options).collect()}
    for r in LOCATE:
        if r[column] is not None and not (column == 3 and r[0] in (5, 9, 10, 11, 50, 51)):
            assert got[r[0]] == r[column]
        if column == 3:  # a start ignores inclusiveness, as the scan's predicate decides
            assert got[r[0]] == r[1]


@pytest.mark.parametrize("local_bytes", [0, 1 << 30])
def test_positions_and_lookups(spark, local_bytes):
    rng = random.Random(3)
    keys = [str(k) for k in rng.sample(range(5000), 300)]
    df = frame(spark, [(k, "v") for k in keys]).repartition(5)
    order = sorted(keys, key=lambda k: (len(k), k))
    got = {r.key.decode(): r.pos for r in O.with_position(df, "klen", "key", local_bytes=local_bytes).collect()}
    assert got == {k: i for i, k in enumerate(order)}
    asked = [str(k) for k in rng.sample(range(5200), 200)]
    probes = spark.createDataFrame([(bytearray(k.encode()), len(k)) for k in asked], "key binary, klen int").repartition(3)
    index = df.select("klen", "key", F.col("key").cast("string").alias("found"))
    for lookup, strict, want in (
        (O.floor_lookup, False, lambda p: max((k for k in map(int, keys) if k <= p), default=None)),
        (O.floor_lookup, True, lambda p: max((k for k in map(int, keys) if k < p), default=None)),
        (O.ceiling_lookup, False, lambda p: min((k for k in map(int, keys) if k >= p), default=None)),
        (O.ceiling_lookup, True, lambda p: min((k for k in map(int, keys) if k > p), default=None)),
    ):
        for r in lookup(probes, index, "found", strict=strict, local_bytes=local_bytes).collect():
            assert (None if r.found is None else int(r.found)) == want(int(r.key))


@pytest.mark.parametrize("local_bytes", [0, 1 << 30])
def test_adjacent(spark, local_bytes):
    keys = [str(k) for k in random.Random(4).sample(range(5000), 300)]
    order = sorted(keys, key=lambda k: (len(k), k))
    df = frame(spark, [(k, "v") for k in keys]).repartition(5)
    got = {r.key.decode(): (r.previous and r.previous.decode(), r.next and r.next.decode()) for r in O.adjacent(df, local_bytes).collect()}
    assert got == {k: (order[i - 1] if i else None, order[i + 1] if i + 1 < len(order) else None) for i, k in enumerate(order)}
    back = {r.key.decode(): r.other and r.other.decode() for r in O.step(df, -3, local_bytes).collect()}
    assert back == {k: order[i - 3] if i >= 3 else None for i, k in enumerate(order)}


@pytest.mark.parametrize("local_bytes", [0, 1 << 40])
def test_nearest_is_linear(spark, local_bytes):
    """200,000 probes of 1,000 index rows: frames that look ahead from each row would take minutes."""
    number = F.col("id").cast("string").cast("binary")
    index = spark.range(0, 400_000, 400).select(F.octet_length(number).alias("klen"), number.alias("key"), F.col("id").alias("found"))
    probes = spark.range(200_000).select(F.octet_length(number).alias("klen"), number.alias("key"), F.col("id"))
    kinds = ("at_most", "below", "at_least", "above")
    began = time.time()
    out = O.nearest(probes, index, "found", {k: k for k in kinds}, local_bytes)
    # Numbers in shortlex order are in their own order.
    low, up = F.floor(F.col("id") / 400) * 400, F.ceil(F.col("id") / 400) * 400
    want = (low, F.when(F.col("id") % 400 == 0, F.when(F.col("id") > 0, F.col("id") - 400)).otherwise(low), up, F.when(F.col("id") % 400 == 0, F.col("id") + 400).otherwise(up))
    same = [F.col(k).eqNullSafe(w) for k, w in zip(kinds, want, strict=True)]
    assert out.where(same[0] & same[1] & same[2] & same[3]).count() == 200_000
    assert time.time() - began < 60


def test_packed_blocks(spark):
    rows = [(str(k), "x" * (k % 7)) for k in range(400)]
    got = [(r.key.decode(), r.block, r.idx) for r in B.packed_blocks(frame(spark, rows), 200, files=1).orderBy("klen", "key").collect()]
    block, idx, size, first, want = 0, 0, 2, "", []
    for k, v in rows:
        shared = next((i for i, (a, b) in enumerate(zip(k, first, strict=False)) if a != b), min(len(k), len(first)))
        want.append((k, block, idx))
        size, idx, first = size + 16 + len(k) - shared + len(v), idx + 1, first or k
        if size > 200:
            block, idx, size, first = block + 1, 0, 2, ""
    assert got == want
    meta = B.block_meta(B.packed_blocks(frame(spark, rows), 200, files=1), "file")
    assert meta.agg(F.sum("n_keys")).first()[0] == 400
    assert B.same_content(frame(spark, rows), frame(spark, rows[::-1])) and not B.same_content(frame(spark, rows), frame(spark, rows[1:]))


def test_erase_insert_step(spark):
    a = frame(spark, [("1", "a"), ("20", "b"), ("3", "c")])
    assert pairs(O.erase(a, frame(spark, [("20", "z"), ("9", "z")]))) == [("1", "a"), ("3", "c")]
    assert pairs(O.insert_missing(a, frame(spark, [("20", "z"), ("9", "z")]))) == [("1", "a"), ("3", "c"), ("9", "z"), ("20", "b")]
    assert {r.key.decode(): r.other and r.other.decode() for r in O.step(a).collect()} == {"1": "3", "3": "20", "20": None}
    assert tuple(map(bytes, O.ends(a).first())) == (b"1", b"20")


def test_bloom_null_keys_and_sizes(spark, monkeypatch):
    rows = spark.createDataFrame([("a",), (None,), ("b",), (None,)], "key string")
    own = Bloom.build(rows, Parameters(4, 0.001))
    assert own.contains(rows).where("not maybe").isEmpty() and own.inserted == 4
    assert Bloom.build(rows.where("key is not null"), Parameters(4, 0.001)).contains(rows).where("key is null and maybe").isEmpty()
    assert Bloom.build(rows.limit(0)).contains(rows).where("maybe").isEmpty()
    many = spark.range(40_000).select(F.col("id").cast("string").alias("key"))
    large = Bloom.build(many.where("key % 2 = 0"), Parameters(20_000, 0.01))
    assert large.buckets % 8 == 0
    counts = [large.contains(many).where("maybe").count()]
    monkeypatch.setattr("sortilex.operators.bloom.BROADCAST_BYTES", 0)
    counts.append(large.contains(many).where("maybe").count())
    assert counts[0] == counts[1] and 20_000 <= counts[0] <= 20_000 + 260


def test_large_bloom_deals_out_keys(spark, monkeypatch):
    """Of a large filter a key goes out as one row, not as one for each of its places; the words are those of a small one."""
    keys = spark.range(40_000).select((F.col("id") % 30_000).cast("string").alias("key"))
    p = Parameters(30_000, 0.01)
    small = Bloom.build(keys, p)
    want = small.words.collect()
    monkeypatch.setattr("sortilex.operators.bloom.COMBINED_BUCKETS", 8)
    monkeypatch.setattr("sortilex.operators.bloom.BUCKETS_A_TASK", 16)
    large = Bloom.build(keys, p)
    assert sorted(large.words.collect()) == sorted(want) and large.inserted == small.inserted == 40_000
    plan = large.words._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange") and "hashpartitioning(bucket" in plan
    assert ((small ^ large).words).isEmpty() and large.contains_all(keys).first()[0]


def test_bloom(spark, tmp_path):
    assert Parameters(512, 0.01).optimal() == (7, 4912)
    with pytest.raises(ValueError):
        Parameters(0).optimal()
    keys = spark.range(1024).select(F.col("id").cast("string").cast("binary").alias("key"), (F.col("id") % 2 == 0).alias("member"))
    even = Bloom.build(keys.where("member"), Parameters(512, 0.01))
    hit = even.contains(keys)
    assert hit.where("member and not maybe").isEmpty() and hit.where("not member and maybe").count() <= 0.01 * 1024 * 1.5
    assert abs(even.effective_fpp() - 0.01) < 0.001 and bool(even) and even.inserted == 512
    odd = Bloom.build(keys.where("not member"), Parameters(512, 0.01))
    assert (even | odd).contains_all(keys).first()[0] and (even ^ even).contains_none(keys).first()[0]
    assert (even & even).same_as(even) and not even.same_as(odd) and even.cleared().contains_none(keys).first()[0]
    assert (even & Bloom.build(keys, Parameters(10, 0.5))).same_as(even)
    assert even.buckets == 2 and even.folded(even.table_size // 2).contains_all(keys.where("member")).first()[0]
    with pytest.raises(ValueError):
        even.folded(even.table_size // 4)
    assert (even ^ odd).set_bits().first()[0] == even.set_bits().first()[0] + odd.set_bits().first()[0] - 2 * (even & odd).set_bits().first()[0]
    assert ((even ^ odd) ^ odd).words.exceptAll(even.words).isEmpty()
    even.write(f"{tmp_path}/bloom")
    assert Bloom.read(spark, f"{tmp_path}/bloom").same_as(even)
