"""Approximate nearest neighbours by cosine, with multiprobe p-stable hashing.

Vectors are scaled to length 1, where the nearest by angle are the nearest by distance. Each table cuts ``functions``
random projections into slots of a width; a query visits its own bucket and then those with some slots changed by one,
in the order of their estimated success (smallest expected sum of squared distances to the slots' borders). The tables'
candidates are merged and ranked by the exact cosine of the original vectors.

Only the k + 1 smallest ids of identical vectors can be among a query's k nearest, so others leave the index at once, and
identical queries are answered once: a vector that a third of the rows share is no burden. Queries go in blocks of
bounded size: a block's probes are broadcast, each task looks its rows up and hands on at most k + 1 rows a query. Queries
whose buckets held too few rows are run once more, against every row of their length.

Random projections of hard vectors (fifth neighbour at cosine 0.4) don't tell them apart well: to find 0.9 of the five nearest,
any setting of tables, functions, width and probes has to meet about two fifths of all vectors, so the index is passed over
and not joined by bucket, which would send each vector to several hundred queries.

Edge cases. Vectors that are null, empty or zero, or hold nulls or values that aren't finite take no part, as queries or
as candidates; null ids neither. Vectors meet only those of the same length. Ties go to the smaller id. Rows that repeat
id and vector are one candidate; an id with several vectors counts at its nearest one, as a
query too, and takes up several of the k + 1 rows that a task hands on. Other columns are read
by ``is_query`` alone, whatever their names. Fewer than k candidates: all of them. Empty table: empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, materialize

TABLES, FUNCTIONS, WIDTH, PROBES, SEED = 16, 12, 2.5, 120, 5
#: Queries of a block: its probes take about 16 bytes * TABLES * PROBES each, in every worker.
BLOCK = 2048
#: Index rows that a task compares with a block at a time.
ROWS = 1024


def probe_order(functions: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of border ranks (0: the nearest border) to cross, best expected score first; the empty set leads."""
    n = 2 * functions
    cost = []
    for j in range(1, n + 1):
        i = j if j <= functions else n + 1 - j
        square = i * (i + 1) / (4 * (functions + 1) * (functions + 2))
        cost.append(square if j <= functions else 1 - i / (functions + 1) + square)
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while len(out) < probes and heap:
        total, ranks = heapq.heappop(heap)
        if len({min(j, n - 1 - j) for j in ranks}) == len(ranks):  # else it would cross both borders of a slot
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < n:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*ranks, last + 1)))
    return out


class Tables:
    """The hash functions for vectors of one length."""

    def __init__(self, dim: int, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, seed: int = SEED) -> None:
        rng = np.random.Generator(np.random.PCG64([seed, dim]))
        self.tables, self.functions, self.width = tables, functions, width
        self.projections = rng.standard_normal((dim, tables * functions))
        self.shifts = rng.uniform(0, width, tables * functions)
        self.mix = rng.integers(1, 1 << 63, functions, dtype=np.uint64) | np.uint64(1)

    def slots(self, unit: np.ndarray) -> np.ndarray:
        """Positions in slots, as numbers of slots: vectors x tables x functions."""
        return ((unit @ self.projections + self.shifts) / self.width).reshape(len(unit), self.tables, self.functions)

    def keys(self, slots: np.ndarray) -> np.ndarray:
        h = (slots.astype(np.int64).astype(np.uint64) * self.mix).sum(axis=-1, dtype=np.uint64)
        return h ^ (h >> np.uint64(29))

    def probes(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """Bucket keys in visiting order: vectors x tables x probes."""
        at = self.slots(unit)
        own = np.floor(at)
        rest = at - own
        order = np.argsort(np.concatenate((rest, 1 - rest), axis=-1), axis=-1, kind="stable")
        out = []
        for ranks in probe_order(self.functions, probes):
            moved = own.copy()
            for r in ranks:
                border = order[..., r : r + 1]
                f = border % self.functions
                np.put_along_axis(moved, f, np.take_along_axis(moved, f, -1) + np.where(border < self.functions, -1, 1), -1)
            out.append(self.keys(moved))
        return np.stack(out, axis=-1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class BlockIndex:
    """A block's queries, found by bucket: per table the probes' keys in order, and whose they are; without probes all meet all."""

    def __init__(self, queries: np.ndarray, tables: Tables, probes: int) -> None:
        self.queries, self.tables = queries, tables
        self.norms = np.linalg.norm(queries, axis=1)
        self.owner, self.keys = [], []
        if not probes:
            return
        keys = tables.probes(_unit(queries), probes)
        for t in range(tables.tables):
            flat = keys[:, t, :].ravel()
            order = np.argsort(flat, kind="stable")
            self.keys.append(flat[order])
            self.owner.append((order // keys.shape[2]).astype(np.int32))

    def candidates(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that share a visited bucket in some table."""
        if not self.keys:
            return np.divmod(np.arange(len(self.queries) * len(rows)), len(rows))
        met = np.zeros((len(self.queries), len(rows)), bool)
        keys = self.tables.keys(np.floor(self.tables.slots(_unit(rows))))
        for t, (known, owner) in enumerate(zip(self.keys, self.owner, strict=True)):
            lo, hi = np.searchsorted(known, keys[:, t], "left"), np.searchsorted(known, keys[:, t], "right")
            n = hi - lo
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            met[owner[at], np.repeat(np.arange(len(rows)), n)] = True
        return np.nonzero(met)

    def cosines(self, q: np.ndarray, r: np.ndarray, rows: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(rows, axis=1)
        out = np.empty(len(q))
        for i in range(0, len(q), 100_000):
            a, b = q[i : i + 100_000], r[i : i + 100_000]
            out[i : i + 100_000] = np.einsum("ij,ij->i", self.queries[a], rows[b]) / (self.norms[a] * norms[b])
        return out


class _Best:
    """The k best (score, then smaller id) of every query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least = k, np.full(n, -np.inf)
        self.q, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        some = scores >= self.least[q]
        q, ids, scores = (np.concatenate(x) for x in ((self.q, q[some]), (self.ids, ids[some]), (self.scores, scores[some])))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        kept = rank < self.k
        self.q, self.ids, self.scores = q[kept], ids[kept], scores[kept]
        full = rank == self.k - 1
        self.least[q[full]] = scores[full]


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (doubles) of vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), v.alias("v"))


def _search(index: DataFrame, ids: list[int], queries: np.ndarray, k: int, tables: Tables, probes: int) -> DataFrame:
    held = index.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), queries, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, tables = held.value
        block, best = BlockIndex(vectors, tables, probes), _Best(len(names), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                rows = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                q, r = block.candidates(rows)
                best.add(q, part.column(0).to_numpy()[r], block.cosines(q, r, rows))
        yield pa.RecordBatch.from_arrays([pa.array(names[best.q]), pa.array(best.ids), pa.array(best.scores)], names=["query", "id", "score"])

    return map_batches(index, run, "query bigint, id bigint, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k nearest found among all rows but itself."""
    flagged = vectors.withColumn(id_col, F.col(id_col).cast("bigint"))
    queries = _valid(flagged.where(is_query), id_col, vector_col).distinct()
    order = Window.partitionBy("v").orderBy("id")
    index = materialize(_valid(flagged, id_col, vector_col).distinct().withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= k + 1).select("id", "v"), "ann-index")
    asked = queries.withColumn("first", F.min("id").over(Window.partitionBy("v")))
    asked = materialize(asked.select("id", "first", F.when(F.col("id") == F.col("first"), F.col("v")).alias("v")), "ann-queries")
    found = None

    def search(own: DataFrame, held: list, made: Tables, probes: int) -> DataFrame:
        part = _search(own, [r[0] for r in held], np.array([r[1] for r in held], np.float64), k + 1, made, probes)
        part = part.groupBy("query", "id").agg(F.max("score").alias("score"))
        best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return materialize(part.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place"), "ann-found")

    for dim in [r[0] for r in asked.where("v is not null").select(F.size("v")).distinct().orderBy(F.size("v")).collect()]:
        own, made = index.where(F.size("v") == dim), Tables(dim, tables, functions, width)
        held: list = []
        rows = asked.where("v is not null").where(F.size("v") == dim).select("id", "v").toLocalIterator()
        while True:
            row = next(rows, None)
            if row is not None:
                held.append(row)
            if held and (row is None or len(held) == block):
                part = search(own, held, made, probes)
                full = {r[0] for r in part.groupBy("query").count().where(F.col("count") > k).select("query").collect()}
                if short := [r for r in held if r[0] not in full]:
                    part = part.where(F.col("query").isin(list(full))) if full else part.limit(0)
                    part = part.unionByName(search(own, short, made, 0))
                found = part if found is None else found.unionByName(part)
                held = []
            if row is None:
                break
    if found is None:
        return asked.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    each = asked.select(F.col("id").alias("query_id"), "first").join(found, F.col("first") == F.col("query")).where("id != query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
