"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table from frequent pieces (white-space pieces with the space before them, see pretokens) to
their numbers of tokens; tier two is each worker's cache, filled by the tokenizer library for pieces that the table
misses. No piece is ever shuffled: the table's candidates are the pieces that make up at least ``share`` of some task's
pieces, as far as the task's counter of bounded size tells: pieces that stay rare for long are dropped and counted anew. Their
number is at most 1 / share for a task and ``table_entries`` in the table. The table only saves time; counts don't depend on it.

Edge cases. Null or empty text: no bytes, no tokens. Ties and repeated rows: each row is counted alone. Empty table:
empty result. Columns besides ``keep`` and the text are not read; a kept column named like a result is replaced by it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches
from .pretokens import encoder, text_groups

#: Least share of a task's pieces for a candidate, most entries and longest piece of the broadcast table (about 2 MB).
SHARE, TABLE_ENTRIES, LONGEST = 1e-4, 16_384, 48
#: Pieces that a task counts before it drops those that have come up once.
COUNTER_ENTRIES = 200_000


def frequent_pieces(docs: DataFrame, text_col: str = "text", share: float = SHARE, entries: int = TABLE_ENTRIES) -> list[str]:
    """Frequent pieces, most frequent first, from all texts; each task hands on 1 / share rows at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    pieces = text.split(" ")[1:]
                    total += len(pieces)
                    seen.update(pieces)
                    if len(seen) > COUNTER_ENTRIES:
                        least = share * total
                        seen = Counter({p: n for p, n in seen.items() if n >= least})
        top = [(p, n) for p, n in seen.items() if n >= share * total and 0 < len(p) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    found = map_batches(docs.select(F.col(text_col)), count, "piece string, n bigint")
    return [r[0] for r in found.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(entries).collect()]


def token_counts(docs: DataFrame, tokenizer_path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` and n_bytes, n_tokens of every whole text."""
    keep = tuple(c for c in keep if c not in {"n_bytes", "n_tokens"})
    enc = encoder(tokenizer_path)
    pieces = [p for p in frequent_pieces(docs, text_col) if not p[0].isspace() and not p[-1].isspace()]
    sizes = [len(x) // enc.dtype.itemsize for x in enc.encode([" " + p for p in pieces])]
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(pieces, sizes, strict=True)))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, enc = table.value, encoder(tokenizer_path)
        for batch in batches:
            n_bytes = [s.as_buffer().size if s.is_valid else 0 for s in batch.column(batch.num_columns - 1)]
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            n_tokens = list(chain.from_iterable(enc.counts_of(group, known) for group in text_groups(texts)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=schema.names)

    return map_batches(docs.select(*keep, F.col(text_col).alias("__text")), count, schema)
