import numpy as np
import pytest
from pyspark.sql import functions as F

from sortilex.llm.neighbours import nearest, probe_order


def brute(vectors, q, k):
    v = np.array(vectors[q])
    near = [(-(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), i) for i, w in vectors.items() if i != q and len(w) == len(v)]
    return [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in near)[:k]]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_recall(spark, sf):
    from sortilex.llm.queries import op7_nearest

    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    found = {}
    for r in op7_nearest(spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.keys() == {i for i in vectors if i % 50 == 0}
    hits = 0
    for q, got in found.items():
        want = brute(vectors, q, 5)
        hits += sum(s >= want[-1][1] - 1e-9 for _, s in got)
        assert len(got) == 5 and [s for _, s in got] == sorted((s for _, s in got), reverse=True)
        v = np.array(vectors[q], np.float64)
        assert all(abs(s - v @ np.array(vectors[i], np.float64) / np.linalg.norm(v) / np.linalg.norm(vectors[i])) < 1e-12 for i, s in got)
    assert hits >= 0.9 * 5 * len(found)


def test_same_vectors_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    same, near = rng.standard_normal(8), rng.standard_normal((40, 8))
    rows = [(i, same.tolist()) for i in range(300)] + [(1000 + i, v.tolist()) for i, v in enumerate(near)]
    rows += [(2000, None), (2050, []), (2100, [0.0] * 8), (2150, [None] + [1.0] * 7), (2200, [float("nan")] + [1.0] * 7), (2250, [float("inf")] + [1.0] * 7), (None, same.tolist()), (2300, [1.0, 2.0]), (2350, [2.0, 4.1]), (50, same.tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit("own"))
    out = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0, probes=400, tables=20, width=4.0, block=2).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    assert set(out) == {0, 50, 100, 150, 200, 250, 1000, 2300, 2350}
    assert out[0] == [1, 2, 3, 4, 5] and out[50] == [0, 1, 2, 3, 4] and out[250] == [0, 1, 2, 3, 4]
    assert out[2300] == [2350] and out[2350] == [2300]
    vectors = {i: v for i, v in rows if i is not None and i < 2000}
    want = brute({1000: vectors[1000], 0: same.tolist(), **{i: v for i, v in vectors.items() if i > 1000}}, 1000, 5)
    assert len(set(out[1000]) & {i for i, _ in want}) >= 3


def test_empty(spark):
    assert nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_probe_order_is_by_expected_score():
    order = probe_order(4, 30)
    assert order[0] == () and order[1] == (0,) and len(set(order)) == len(order) == 30
    assert all(len({min(j, 7 - j) for j in ranks}) == len(ranks) for ranks in order)


def test_small_tables_and_rare_lengths_get_all_that_are_due(spark):
    rng = np.random.default_rng(8)
    sizes = {24: 5, 25: 6, 26: 10, 64: 200}
    vectors, rows = {}, []
    for dim, n in sizes.items():
        for _ in range(n):
            vectors[len(rows)] = rng.standard_normal(dim).tolist()
            rows.append((len(rows), vectors[len(rows)]))
    out = {}
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for r in nearest(df, F.col("vec_id") < 30).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(30):
        assert len(out[q]) == min(5, sizes[len(vectors[q])] - 1)
        if len(vectors[q]) < 26:
            assert out[q] == [i for i, _ in brute(vectors, q, 5)]


def test_ids_with_several_vectors_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (2, [-1.0, 0.0]), (3, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("own") for c in ("id", "v", "first", "query", "score", "copy", "place", "query_id")})
    got = [(r.rank, r.vec_id, round(r.score, 6)) for r in nearest(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    near = round(1 / np.hypot(1, 0.1), 6)
    assert got == [(1, 1, near), (2, 2, near), (3, 3, round(-1 / np.sqrt(2), 6))]
