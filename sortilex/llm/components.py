"""Connected components of an edge table, by random contraction.

Each round every node takes the neighbour (or itself) with the smallest random number; edges are moved to the nodes taken
and those within one node go. Each round removes a share of the nodes whatever the graph's shape, so a few rounds do.
A hub's smallest number is found by partial aggregation, and the joins that move edges are ones that adaptive execution
splits where a key has many rows. Once at most ``local_edges`` edges are
left, one task finishes them with a union-find.

Edge cases. Self loops and repeated edges don't matter. No edges: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

#: Edges (about 40 bytes each) that one task may take.
LOCAL_EDGES = 300_000


def union_find(pairs: list[tuple]) -> dict:
    """Smallest member of its component for each node."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _finish(edges: DataFrame) -> DataFrame:
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, typed = [], None
        for batch in batches:
            typed = batch.column(0).type
            pairs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        found = union_find(pairs)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), typed), pa.array(list(found.values()), typed)], names=["node", "root"])

    return map_batches(edges.coalesce(1), run, f"node {kind}, root {kind}")


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, root for all nodes of edges (a, b); nodes of one component share a root, which is one of them."""
    left = materialize(edges.select("a", "b").where("a != b").distinct(), "cc-edges", small=True)
    maps: list[DataFrame] = []
    while (n := left.count()) > local_edges:
        number = str(len(maps))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit(number), "b").alias("h"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(F.xxhash64(F.lit(number), "a").alias("h"), F.col("a").alias("to"))
        taken = materialize(nearest.select(F.col("a").alias("node"), F.least("m", own)["to"].alias("root")), "cc-map", small=True)
        maps.append(taken)
        moved = left.join(taken.toDF("a", "ra"), "a").join(taken.toDF("b", "rb"), "b")
        left = materialize(moved.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges", small=True)
    out = materialize(_finish(left), "cc-map") if n else None
    for taken in reversed(maps):
        if out is None:
            out = taken
        else:
            later = out.toDF("__n", "__r")
            out = taken.join(later, F.col("root") == F.col("__n"), "left").select("node", F.coalesce("__r", "root").alias("root"))
    return out if out is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
