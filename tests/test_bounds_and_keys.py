import random

import pytest
from pyspark.sql import functions as F

from sortilex.functions import keys as K
from sortilex.operators.bounds import NEG_INF, POS_INF, Bound, in_range, is_valid, scan

at = Bound.at


@pytest.mark.parametrize(
    ("start", "end", "valid"),
    [(NEG_INF, POS_INF, True), (NEG_INF, NEG_INF, False), (POS_INF, POS_INF, False), (POS_INF, NEG_INF, False), (POS_INF, at(1), False), (NEG_INF, at(1), True), (at(1), NEG_INF, False), (at(1), POS_INF, True)]
    + [(at(1, a), at(1, b), a and b) for a in (True, False) for b in (True, False)]
    + [(at(9), at(10), True), (at(10), at(9), False), (at(112, False), at(111), False), (at(1003), at(11111, False), True)],
)
def test_validity(start, end, valid):
    assert is_valid(start, end) == valid


def test_scan_against_model(spark):
    rng = random.Random(0)
    keys = sorted({bytes(rng.choice(b"\x00a\x7f\x80\xff") for _ in range(rng.randint(0, 4))) for _ in range(200)}, key=lambda k: (len(k), k))
    df = spark.createDataFrame([(bytearray(k), len(k)) for k in keys], "key binary, klen int").cache()
    bounds = [NEG_INF, POS_INF, *(Bound(0, rng.choice(keys), rng.random() < 0.5) for _ in range(4)), Bound(0, b"zz", True)]
    for start in bounds:
        for end in bounds:
            after = lambda k, b: b.infinity < 0 or not b.infinity and ((len(k), k) > (len(b.key), b.key) or k == b.key and b.inclusive)
            before = lambda k, b: b.infinity > 0 or not b.infinity and ((len(k), k) < (len(b.key), b.key) or k == b.key and b.inclusive)
            want = [k for k in keys if after(k, start) and before(k, end)]
            assert [bytes(r.key) for r in scan(df, start, end).orderBy("klen", "key").collect()] == want


def test_range_reaches_the_scan(spark, tmp_path):
    K.entries(spark.range(1000), "id", "id").write.parquet(f"{tmp_path}/run")
    plan = scan(spark.read.parquet(f"{tmp_path}/run"), at(10), at(500, False))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThan(klen,2)" in pushed and "LessThan(kl" in pushed
    assert not is_valid(at(5), at(4)) and spark.range(5).select(F.lit(1).alias("klen"), F.lit(b"1").alias("key")).where(in_range(at(5), at(4))).isEmpty()


def test_compare(spark):
    pairs = [("1234", "12345", -1), ("12345", "1234", 1), ("", "1", -1), ("1234", "1234", 0), ("55", "9", 1), ("a", "b", -1)]
    df = spark.createDataFrame([(bytearray(a.encode()), bytearray(b.encode()), c) for a, b, c in pairs], "a binary, b binary, c int")
    assert df.where(K.compare("a", "b") != F.col("c")).isEmpty()


def test_overlap_and_splice(spark):
    rng = random.Random(1)
    pairs = [(bytes(rng.choice(b"ab\xff\x00") for _ in range(rng.randint(0, 6))), bytes(rng.choice(b"ab\xff\x00") for _ in range(rng.randint(0, 6)))) for _ in range(200)]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in pairs], "a binary, b binary").withColumn("n", K.overlap("a", "b"))
    for r in df.withColumn("again", K.splice("b", "n", K.rest_after("a", "n"))).collect():
        n = next((i for i, (x, y) in enumerate(zip(r.a, r.b, strict=False)) if x != y), min(len(r.a), len(r.b)))
        assert r.n == n and bytes(r.again) == bytes(r.a)


def test_codecs(spark):
    row = spark.range(1).select(F.hex(K.little_endian(F.lit(0x01020304), 4)).alias("le"), K.from_little_endian(K.little_endian(F.lit(70_000), 4), 0, 4).alias("n"), K.checksum(F.lit(b"123456789")).alias("crc"), K.printable(F.lit(b"a\x00b")).alias("p"), K.is_empty(F.lit(b"")).alias("e")).first()
    assert (row.le, row.n, row.crc, row.p, row.e) == ("04030201", 70_000, 0xCBF43926, "a#b", True)
