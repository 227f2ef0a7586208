"""Token ids in Arrow files of fixed-size lists, for zero-copy random access.

Documents are range-partitioned and sorted by id; each partition becomes one shard, an Arrow IPC file whose record
batches hold ``seq_len`` ids a row (fixed-size list of uint16 or uint32, by vocabulary) with two bit masks of the same
shape: ``mask`` (a real token, not padding) and ``last`` (the last token of a document). Only a shard's final row is
padded. A reader maps the file and takes any row, or any document, without copying. Beside each shard lies a small Arrow
file with the documents' ids and their offsets in the shard. Files are written under a temporary name and then moved, so
a task that is run again, or twice at once, leaves the same bytes under the same name.

Edge cases. Null or empty text: the end id alone. Documents with a null id come first; rows with the same id follow one
another by text; repeated rows each are written. Empty table: no shards. Columns besides the id and text are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, new_path, small_batches
from .pretokens import encoder, text_groups

SEQ_LEN, ROWS_PER_BATCH = 1024, 256

def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder: file:, hdfs:, s3: or gs: addresses, or a plain path."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class _ShardWriter:
    """Writes rows of ``seq_len`` ids; memory holds one record batch."""

    def __init__(self, root: str, name: str, dtype: np.dtype, seq_len: int) -> None:
        self.fs, path = _filesystem(root)
        self.path = f"{path}/{name}"
        self.part = f"{path}/.{name}.{os.getpid()}-{uuid.uuid4().hex}"
        self.fs.create_dir(path, recursive=True)
        self.seq_len, self.dtype = seq_len, dtype
        ids = pa.list_(pa.uint16() if dtype.itemsize == 2 else pa.uint32(), seq_len)
        bits = pa.list_(pa.bool_(), seq_len)
        self.schema = pa.schema([("input_ids", ids), ("mask", bits), ("last", bits)])
        self.sink = self.fs.open_output_stream(self.part)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[bytes] = []
        self.n_held = self.n_tokens = 0
        self.ids: list[int | None] = []
        self.starts: list[int] = []
        self.sizes: list[int] = []
        self.ends: list[int] = []  # of documents whose last token is not yet written

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.ids.append(doc_id)
        self.starts.append(self.n_tokens)
        self.sizes.append(n)
        self.ends.append(self.n_tokens + n - 1)
        self.held.append(ids)
        self.n_held += n
        self.n_tokens += n
        if self.n_held >= 4 * self.seq_len * ROWS_PER_BATCH:
            self._flush(False)

    def _flush(self, end: bool) -> None:
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        at = self.n_tokens - len(flat)  # of flat's first id in the shard
        n = len(flat) if end else len(flat) // self.seq_len * self.seq_len
        ends = np.array(self.ends, np.int64) - at
        last = np.zeros(n, bool)
        last[ends[ends < n]] = True
        self.ends = (ends[ends >= n] + at).tolist()
        pad = -n % self.seq_len
        if n:
            parts = [flat[:n], np.ones(n, bool), last]
            self._write(*(np.pad(x, (0, pad)) for x in parts) if pad else parts)
        self.held, self.n_held = [flat[n:].tobytes()], len(flat) - n

    def _write(self, ids: np.ndarray, mask: np.ndarray, last: np.ndarray) -> None:
        step = self.seq_len * ROWS_PER_BATCH
        for i in range(0, len(ids), step):
            part = [ids[i : i + step], mask[i : i + step], last[i : i + step]]
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in part]
            self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.sink.close()
        index = pa.table({"doc_id": pa.array(self.ids, pa.int64()), "start": pa.array(self.starts, pa.int64()), "n_tokens": pa.array(self.sizes, pa.int64())})
        with self.fs.open_output_stream(self.part + ".index") as sink, pa.ipc.new_file(sink, index.schema) as writer:
            writer.write_table(index)
        self.fs.move(self.part + ".index", self.path + ".index")
        self.fs.move(self.part, self.path)


def open_shard(uri: str) -> pa.ipc.RecordBatchFileReader:
    """A shard's reader; local shared folders are mapped, so rows are views of the file."""
    fs, path = _filesystem(uri)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


def read_documents(uri: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Every document of a shard: id, start in the shard and ids, checked against the stored masks."""
    fs, path = _filesystem(uri + ".index")
    with fs.open_input_file(path) as source:
        index = pa.ipc.open_file(source).read_all()
    reader, k, held, held_at = open_shard(uri), 0, np.empty(0, np.uint16), 0
    for doc_id, start, n in zip(*(index.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens")), strict=True):
        parts = [held] if held_at + len(held) > start else []
        have = held_at + len(held)
        while have < start + n:
            batch = reader.get_batch(k)
            k += 1
            own, mask = (batch.column(j).flatten() for j in (0, 1))
            real = own.to_numpy() if mask.true_count == len(mask) else own.to_numpy()[mask.to_numpy(zero_copy_only=False)]
            if not parts:
                held_at = have
            parts.append(real)
            have += len(real)
        held = parts[0] if len(parts) == 1 else np.concatenate(parts)
        yield doc_id, start, held[start - held_at : start - held_at + n]


def write_shards(docs: DataFrame, tokenizer_path: str, root: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, shards: int | None = None) -> DataFrame:
    """Encode all texts into shards under ``root``; the manifest: shard, path, n_docs, n_tokens and start (tokens before).

    Without ``shards`` their number is the session's of shuffle partitions, merged up to its advisory size.
    """
    spark: SparkSession = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    number = [] if shards is None else [shards]
    ordered = slim.repartitionByRange(*number, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc, out = encoder(tokenizer_path), None
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            out = out or _ShardWriter(root, f"shard-{shard:06d}.arrow", enc.dtype, seq_len)
            ids = chain.from_iterable(enc.ids_of(group) for group in text_groups(batch.column(1).to_pylist()))
            for doc_id, own in zip(batch.column(0).to_pylist(), ids, strict=True):
                out.add(doc_id, own + end)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([f"{root}/shard-{shard:06d}.arrow"]), pa.array([len(out.ids)], pa.int64()), pa.array([out.n_tokens], pa.int64())], names=["shard", "path", "n_docs", "n_tokens"])

    manifest = map_batches(ordered, write, "shard bigint, path string, n_docs bigint, n_tokens bigint")
    with small_batches(spark):
        manifest.write.parquet(f"{root}/manifest")
    manifest = spark.read.parquet(f"{root}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one short row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("bigint"))


def read_back(manifest: DataFrame) -> DataFrame:
    """From the shards of a manifest: doc_id, start, n_tokens and ids_crc32 of every document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(*(batch.column(j).to_pylist() for j in (0, 1)), strict=True):
                found = [(d, before + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in read_documents(path)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    paths = manifest.select("path", "start")
    return map_batches(paths.repartition(max(1, paths.count())), read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, **options) -> DataFrame:
    """Write shards into a new folder of the shared storage and read every document back."""
    return read_back(write_shards(docs, tokenizer_path, new_path(docs.sparkSession, "tokens"), end_id, **options))
