"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Texts are normalised to lower-case words joined by single spaces; every window of ``window`` consecutive item words
(the whole item, if it is shorter) becomes one pattern with spaces at both ends, so a match always covers whole words.
Each text passes through the automaton once. Matches are mapped back to characters of the original text.

Edge cases. Null or empty text: no words, no hits. Null item text, or an item without words: no window. Items with a
null id are left out, because a hit could not name them; repeated item ids are one item. Repeated documents each get
their own row. Empty tables give empty results, and an empty benchmark hits nothing. Columns besides those in ``keep``
are not read; a kept column named like a result column is replaced by the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, map_batches, materialize, worker_cache

WINDOW = 8
#: Bytes of different patterns in one automaton, which takes some 40 times as many in a worker. Larger benchmarks are
#: scanned in several blocks, one pass each.
BLOCK_BYTES = 8 << 20

def windows(text: bytes, window: int) -> list[tuple[bytes, int]]:
    """Patterns of one item with their number of words."""
    w = text.translate(WORD_TABLE).split()
    n = min(window, len(w))
    return [(b" " + b" ".join(w[i : i + n]) + b" ", n) for i in range(len(w) - n + 1)] if n else []


def _blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[dict[bytes, tuple[int, set[str]]]]:
    """Pattern tables of bounded size; items stream to the driver one partition at a time."""
    block: dict[bytes, tuple[int, set[str]]] = {}
    size = full = 0
    for item_id, text in items.toLocalIterator():
        for pattern, n in windows(text.encode(), window):
            if pattern not in block:
                size += len(pattern)
                block[pattern] = (n, set())
            block[pattern][1].add(item_id)
            if size >= block_bytes:
                yield block
                block, size, full = {}, 0, full + 1
    if block or not full:
        yield block


def _automaton(key: str, block: dict[bytes, tuple[int, set[str]]]) -> ahocorasick.Automaton:
    def build() -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for pattern, value in block.items():
            a.add_word(pattern.decode("latin-1"), value)
        a.make_automaton()
        return a

    return worker_cache(("automaton", key), build)


def scan_text(text: bytes, a: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit word ranges [first, last] and ids of the items that occur."""
    w = text.translate(WORD_TABLE).split()
    norm = b" " + b" ".join(w) + b" "
    found = list(a.iter(norm.decode("latin-1"))) if w and len(a) else []
    if not found:
        return len(w), [], set()
    space = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    last = np.searchsorted(space, [e for e, _ in found]) - 1
    ranges, ids = [], set()
    for k, (_, (n, own)) in zip(last.tolist(), found, strict=True):
        ranges.append((k - n + 1, k))
        ids.update(own)
    return len(w), ranges, ids


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint ranges that cover the same words."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def char_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of word ranges."""
    inside = np.frombuffer(text.translate(WORD_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[starts[lo]]), int(chars[ends[hi]])) for lo, hi in ranges]


RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` and, for each document: n_words, n_hit, n_items, items (ids, sorted as text), hits and spans.

    hits holds the hit passages as word numbers, spans as character offsets of the original text.
    """
    spark: SparkSession = docs.sparkSession
    keep = tuple(c for c in keep if c not in {"n_hit", "n_items", *(f.name for f in RESULT)})
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("string"), F.col(item_text_col))
    text_at = keep.index(text_col) if text_col in keep else len(keep)
    df = docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias("__text")]))
    blocks = _blocks(items, window, block_bytes)
    k, following = 0, next(blocks)
    while following is not None:
        block, following = following, next(blocks, None)
        if k:
            df = materialize(df, "decontaminate")
        more = following is not None and text_col not in keep  # the text goes along for the next block
        names = [*keep, *(f.name for f in RESULT), *(["__text"] if more else [])]
        held, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex
        schema = T.StructType([*(docs.schema[c] for c in keep), *RESULT, *([T.StructField("__text", T.StringType())] if more else [])])

        def scan(batches: Iterator[pa.RecordBatch], held=held, key=key, names=names, first=not k) -> Iterator[pa.RecordBatch]:
            a = _automaton(key, held.value)
            types = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in RESULT])
            for batch in batches:
                text = batch.column(text_at if text_at < len(keep) else batch.num_columns - 1)
                old = None if first else [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("hits", "items")]
                rows = []
                for i, s in enumerate(text):
                    raw = s.as_buffer().to_pybytes() if s.is_valid else b""
                    n, ranges, ids = scan_text(raw, a)
                    if old is not None:
                        ranges += [(h["first"], h["last"]) for h in old[0][i]]
                        ids |= set(old[1][i])
                    ranges = merge_ranges(ranges)
                    spans = [{"start": s0, "end": e0} for s0, e0 in char_spans(raw, ranges)] if ranges else []
                    rows.append((n, [{"first": lo, "last": hi} for lo, hi in ranges], sorted(ids), spans))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(RESULT)
                out = [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(c, types.field(j).type) for j, c in enumerate(cols)] + [text]
                yield pa.RecordBatch.from_arrays(out[: len(names)], names=names)

        df = map_batches(df, scan, schema)
        k += 1
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + h["last"] - h["first"] + 1)
    return df.select(*keep, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hits", "spans")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
