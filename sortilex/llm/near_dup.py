"""Near duplicates by an LSH forest of MinHash signatures, with links confirmed on full shingle sets.

1. Documents with the same shingle set form a class; one of them stands for all.
2. Every tree of the forest sorts the classes by its own stretch of the signature. In a sorted order the neighbours are
   those with the longest common prefix, so the depth adapts to how crowded a region is. A class and its nearest
   neighbours in an order become a candidate if their signatures agree in at least ``candidate`` of all 128 places.
   Candidates are a few for each class and tree, whatever the size of a group.
3. Candidates make families (connected components). A link between two documents lies within one family unless all
   trees miss it. Within a family links are found on the full sets: documents are compared with all others one at a
   time, the most central first, until every document outside the largest component has been compared with all. Any
   link between two components has an end outside the largest one, so none is lost, and a family of copies around
   one original takes one comparison a copy.
4. A family too large for a task is cut into blocks. Blocks are solved alone, then their most central members and after
   that all documents outside the family's largest component are compared with every block.

Edge cases. Null or empty text, or no words: no shingles, linked with nothing. Fewer words than a shingle: the whole
sequence is one. Null ids take part; a component's id is its smallest id that isn't null. Rows with the same id are
different documents if their texts differ. Empty table: empty result. A column named like a result is not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, materialize, temporary, tokens, worker_cache
from .components import components

SHINGLE, TREES, DEPTH = 5, 16, 8
#: All places of the signature.
COMPARED = TREES * DEPTH
#: Share of compared places for a candidate, and how many neighbours before it a class is compared with.
CANDIDATE, NEIGHBOURS = 0.58, 3
#: Shingles of a family that one task takes (8 bytes each), and of a block or a chunk of pivots beyond that.
FAMILY_SHINGLES, BLOCK_SHINGLES = 4_000_000, 2_000_000
#: Rows (about 40 bytes) of a table of family members that is broadcast instead of shuffling the texts.
BROADCAST_ROWS = 500_000
#: Share of all rows from which on a class's rows find its component by broadcast; there are 1 / share such classes at most.
HOT_SHARE = 1e-3
CACHE_WORDS = 300_000

_rng = np.random.Generator(np.random.PCG64(9_001))
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_MUL = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles."""
    own = tokens(text or b"")
    if not own:
        return np.empty(0, np.uint64)
    known: dict[bytes, int] = worker_cache(("word hashes",), dict)
    h = np.fromiter(map(known.get, own, repeat(0)), np.uint64, len(own))
    missing = np.flatnonzero(h == 0)
    if len(missing):
        if len(known) + len(missing) > CACHE_WORDS:
            known.clear()
        for i in missing.tolist():
            w = own[i]
            h[i] = known[w] = xxhash.xxh64_intdigest(w) or 1
    n = min(size, len(own))
    s = np.full(len(own) - n + 1, n, np.uint64)
    for i in range(n):
        s += h[i : len(own) - n + 1 + i] * _PLACE[i]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0x9E3779B97F4A7C15)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest of each random hash function's values, as 32-bit numbers."""
    least = np.full(TREES * DEPTH, 1 << 32, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048, None] * _MUL + _ADD
        least = np.minimum(least, (part >> np.uint64(32)).min(axis=0))
    return least.astype(np.uint32)


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """id, n (shingles), cls (16 bytes that stand for the set; null if empty) and sig."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, sig = [], [], []
            for s in batch.column(1):
                shingles = shingle_set(s.as_buffer().to_pybytes() if s.is_valid else None, size)
                n.append(len(shingles))
                cls.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                sig.append(signature(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], names=["id", "n", "cls", "sig"])

    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"id {kind}, n bigint, cls binary, sig binary")


def add_class(docs: DataFrame, name: str, text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The documents with the class that sign gives them."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(s.as_buffer().to_pybytes() if s.is_valid else None, size) for s in batch.column(at)]
            cls = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, cls], names=schema.names)

    return map_batches(docs, run, schema)


def _plant(classes: DataFrame) -> DataFrame:
    """A row for each class and tree: the tree, its sort key, the class and the compared bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                n = part.num_rows
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(n, TREES, DEPTH)
                keys = sig.astype(np.uint16).astype(">u2").transpose(1, 0, 2).tobytes()
                step = 2 * DEPTH
                small = [x.tobytes() for x in sig.reshape(n, -1)[:, :COMPARED].astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(TREES, dtype=np.int32), n)), pa.array([keys[i : i + step] for i in range(0, len(keys), step)], pa.binary()), pa.array(part.column(0).to_pylist() * TREES, pa.binary()), pa.array(small * TREES, pa.binary())], names=["tree", "key", "cls", "small"])

    return map_batches(classes.select("cls", "sig"), run, "tree int, key binary, cls binary, small binary")


def _neighbours(rows: Iterator[pa.RecordBatch], candidate: float, with_ends: bool) -> Iterator[pa.RecordBatch]:
    """Candidates among rows in order; with_ends also gives the first and last rows, for the next partition."""
    names = ["a", "b", "tree", "key", "small"]
    head, tail = [], []
    ends = lambda r: pa.RecordBatch.from_arrays([pa.array([x[2] for x in r], pa.binary()), pa.nulls(len(r), pa.binary()), pa.array([x[0] for x in r], pa.int32()), pa.array([x[1] for x in r], pa.binary()), pa.array([x[3] for x in r], pa.binary())], names=names)
    for batch in rows:
        own = tail + list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if with_ends and len(head) < NEIGHBOURS:
            head = (head + own[len(tail) :])[:NEIGHBOURS]
        small = np.frombuffer(b"".join(x[3] for x in own), np.uint8).reshape(-1, COMPARED)
        tree = np.array([x[0] for x in own])
        a, b = [], []
        for k in range(1, NEIGHBOURS + 1):
            if len(own) > k:
                near = ((small[k:] == small[:-k]).sum(axis=1) >= candidate * COMPARED) & (tree[k:] == tree[:-k])
                near[: max(0, len(tail) - k)] = False  # compared before
                for i in np.flatnonzero(near).tolist():
                    a.append(min(own[i][2], own[i + k][2]))
                    b.append(max(own[i][2], own[i + k][2]))
        tail = own[-NEIGHBOURS:]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.binary())], names=names)
    if with_ends and (head or tail):
        yield ends(list(dict.fromkeys(head + tail)))


def candidates(classes: DataFrame, candidate: float = CANDIDATE) -> DataFrame:
    """Different pairs (a, b) of neighbouring classes in some tree's order."""
    schema = "a binary, b binary, tree int, key binary, small binary"
    order = ("tree", "key", "cls")
    forest = _plant(classes).repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(map_batches(forest, lambda rows: _neighbours(rows, candidate, True), schema), "dedup-candidates")
    seams = found.where("b is null").select("tree", "key", F.col("a").alias("cls"), "small").repartition(1).sortWithinPartitions(*order)  # a few rows for each partition
    across = map_batches(seams, lambda rows: _neighbours(rows, candidate, False), schema)
    return found.where("b is not null").select("a", "b").unionByName(across.select("a", "b")).distinct()


class _Sets:
    """Shingle sets of some documents, for comparing one with all."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.different, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.at = at.astype(np.int32)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.mark = np.zeros(len(self.different), bool)

    def of(self, i: int) -> np.ndarray:
        return self.different[self.at[self.starts[i] : self.starts[i] + self.sizes[i]]]

    def linked(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        """Positions of documents whose similarity with a set is at least that many hundredths."""
        place = np.searchsorted(self.different, shingles)
        place = place[(place < len(self.different)) & (self.different[np.minimum(place, len(self.different) - 1)] == shingles)]
        self.mark[place] = True
        both = np.add.reduceat(self.mark[self.at].astype(np.int32), self.starts).astype(np.int64)
        self.mark[place] = False
        return np.flatnonzero(100 * both >= percent * (self.sizes + len(shingles) - both))

    def central(self) -> np.ndarray:
        """Positions, the document with the most widely shared shingles first."""
        shared = np.add.reduceat(np.bincount(self.at, minlength=len(self.different))[self.at].astype(np.float64), self.starts)
        return np.argsort(-shared / self.sizes, kind="stable")


def solve(sets: list[np.ndarray], percent: int) -> tuple[list[int], int]:
    """Component (its first member's position) of each set, and the most central position."""
    s, m = _Sets(sets), len(sets)
    order = s.central()
    label = np.arange(m)
    done = np.zeros(m, bool)
    while True:
        sizes = np.bincount(label, minlength=m)
        largest = int(sizes.argmax()) if sizes.max() > 1 else int(label[order[0]]) if done[order[0]] else -1
        open_ = order[~done[order] & (label[order] != largest)]
        if not len(open_):
            return label.tolist(), int(order[0])
        p = int(open_[0])
        done[p] = True
        near = np.unique(label[s.linked(s.of(p), percent)])
        if len(near) > 1:
            label[np.isin(label, near)] = near[0]


def _sets_of(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column]


def _small_families(members: DataFrame, percent: int) -> DataFrame:
    """cls, root for families that fit in a task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cls", ignore_index=True)
        label, _ = solve(_sets_of(group["shingles"]), percent)
        return pd.DataFrame({"cls": group["cls"], "root": group["cls"].to_numpy()[label]})

    return members.groupBy("family").applyInPandas(run, "cls binary, root binary")


def _large_families(members: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """As _small_families, for families of any size; members has family, cls, n, shingles and total."""
    blocks = F.ceil(F.col("total") / block_shingles).cast("int")
    dealt = materialize(members.withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int")), "dedup-blocks")

    def alone(group: pd.DataFrame) -> pd.DataFrame:
        label, hub = solve(_sets_of(group["shingles"]), percent)
        return pd.DataFrame({"a": group["cls"], "b": group["cls"].to_numpy()[label], "hub": np.arange(len(group)) == hub})

    first = materialize(dealt.groupBy("family", "block").applyInPandas(alone, "a binary, b binary, hub boolean"), "dedup-alone")

    def against(pivots: DataFrame) -> DataFrame:
        """Links of pivots (cls) with every member of their families: each block meets the pivots in bounded chunks."""
        own = dealt.join(pivots.select("cls").distinct(), "cls", "left_semi")
        sizes = own.groupBy("family").agg(F.sum("n").alias("pivot_n"))
        chunks = F.greatest(F.ceil(F.col("pivot_n") / block_shingles), F.lit(1)).cast("int")
        left = dealt.join(sizes, "family").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select("family", "block", "chunk", F.lit(False).alias("pivot"), "cls", "shingles")
        right = own.join(sizes, "family").withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit("pivot")), chunks).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select("family", "block", "chunk", F.lit(True).alias("pivot"), "cls", "shingles")

        def meet(group: pd.DataFrame) -> pd.DataFrame:
            held, pivot = group[~group["pivot"]], group[group["pivot"]]
            found: list[tuple[bytes, bytes]] = []
            if len(held) and len(pivot):
                s, names = _Sets(_sets_of(held["shingles"])), held["cls"].to_numpy()
                for cls, shingles in zip(pivot["cls"], _sets_of(pivot["shingles"]), strict=True):
                    found += [(cls, names[i]) for i in s.linked(shingles, percent) if names[i] != cls]
            return pd.DataFrame(found, columns=["a", "b"])

        return left.unionByName(right).groupBy("family", "block", "chunk").applyInPandas(meet, "a binary, b binary")

    links = materialize(first.select("a", "b").unionByName(against(first.where("hub").select(F.col("a").alias("cls")))), "dedup-links")
    roots = components(links)
    placed = dealt.select("family", "cls").join(roots.toDF("cls", "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    most = placed.groupBy("family", "root").count().groupBy("family").agg(F.max_by("root", F.struct("count", "root")).alias("largest"))
    outside = placed.join(most, "family").where("root != largest").select("cls")
    links = links.unionByName(against(materialize(outside, "dedup-outside")))
    return dealt.select("cls").join(components(links).toDF("cls", "root"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"))


def _roots(docs: DataFrame, percent: int, id_col: str, text_col: str, size: int, family_shingles: int, block_shingles: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signed documents (id, n, cls, sig), classes (cls, least, n, sig) and the components (cls, root) of classes in families."""
    signed = materialize(sign(docs, id_col, text_col, size), "dedup-signed", outlive=True)
    classes = materialize(signed.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies")), "dedup-classes", small=True, outlive=True)
    families = materialize(components(candidates(classes)).toDF("cls", "family").join(classes.select("cls", "n", "least"), "cls"), "dedup-families", small=True)
    totals = families.groupBy("family").agg(F.sum("n").alias("total"))
    families = families.join(totals, "family")

    # Ids that name one text find it again; where an id is null or stands for several texts, classes are made anew.
    several = signed.where("id is not null and cls is not null").groupBy("id").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y").select("id")
    several = materialize(several, "dedup-several", small=True)
    unclear = materialize(classes.where("least is null").select("cls").unionByName(classes.join(several, F.col("least") == F.col("id"), "left_semi").select("cls")), "dedup-unclear", small=True)
    any_unclear = not unclear.isEmpty()

    def sets_of_texts(rows: DataFrame, names: list[str]) -> DataFrame:
        """``names``, and the class and shingle set of the text, which is the last column."""
        schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("made", T.BinaryType()), T.StructField("shingles", T.BinaryType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 500):
                    part = batch.slice(lo, 500)
                    sets = [shingle_set(s.as_buffer().to_pybytes() if s.is_valid else None, size).tobytes() for s in part.column(part.num_columns - 1)]
                    made = [hashlib.blake2b(x, digest_size=16).digest() for x in sets]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, pa.binary()), pa.array(sets, pa.binary())], names=schema.names)

        return map_batches(rows, run, schema)

    def with_shingles(part: DataFrame) -> DataFrame:
        """The members' sets, one row a class, made anew from the texts."""
        few = (lambda df: F.broadcast(df)) if part.count() <= broadcast_rows else (lambda df: df)
        names = ["family", "cls", "n", "total"]
        texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
        wanted = part.select(*names, F.col("least").alias("__least"))
        clear = wanted.join(unclear, "cls", "left_anti") if any_unclear else wanted
        rows = texts.join(few(clear), F.col("__id") == F.col("__least")).select(*names, "__text")
        out = sets_of_texts(rows, names).where("made = cls").select(*names, "shingles")
        if any_unclear:
            nameless = texts.where("__id is null").unionByName(texts.join(several.toDF("__id"), "__id", "left_semi")).select("__text")
            made = sets_of_texts(nameless, []).dropDuplicates(["made"])
            out = out.unionByName(made.join(few(wanted.join(unclear, "cls", "left_semi")), F.col("made") == F.col("cls")).select(*names, "shingles"))
        return out.dropDuplicates(["cls"])

    roots = _small_families(with_shingles(families.where(F.col("total") <= family_shingles)), percent)
    large = families.where(F.col("total") > family_shingles)
    if not large.isEmpty():
        roots = roots.unionByName(_large_families(with_shingles(large), percent, block_shingles))
    roots = materialize(roots.distinct(), "dedup-roots", outlive=True)
    return signed, classes, roots


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, family_shingles: int = FAMILY_SHINGLES, block_shingles: int = BLOCK_SHINGLES, broadcast_rows: int = BROADCAST_ROWS, with_class: bool = False) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links) and kept, a row for each document.

    with_class adds cls, which stands for the shingle set, and root, a class of the component; both are null without shingles.
    Documents are linked if 100 times the shared shingles are at least ``percent`` times all of both.
    """
    kind = docs.schema[id_col].dataType
    with temporary(docs.sparkSession):
        signed, classes, roots = _roots(docs, percent, id_col, text_col, size, family_shingles, block_shingles, broadcast_rows)
    placed = classes.select("cls", "least").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    found = placed.join(ids, "root", "left").select("cls", "root", F.coalesce("component_id", "least").alias("component_id"))
    own = signed.select("id", "n", "cls")
    # Rows without a class, and those of the few classes that many rows share, don't meet in one task.
    hot = classes.where(F.col("copies") >= HOT_SHARE * F.lit(signed.count())).select("cls")
    few = F.broadcast(found.join(F.broadcast(hot), "cls"))
    none = own.where("cls is null").select("cls", "id", "n", F.lit(None).cast("binary").alias("root"), F.lit(None).cast(kind).alias("component_id"))
    rest = own.where("cls is not null").join(F.broadcast(hot), "cls", "left_anti").join(found, "cls")
    out = none.unionByName(own.join(few, "cls")).unionByName(rest)
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).cast(kind)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), *(("cls", "root") if with_class else ()))
