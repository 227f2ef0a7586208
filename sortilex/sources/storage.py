"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import threading
import time
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where that is unset and all executors are this machine's one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="sortilex-"))
        base = sc._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


_scopes = threading.local()


def new_path(spark: SparkSession, name: str, outlive: bool = False) -> str:
    """A new folder of the shared storage; within temporary() it goes at the end, or with ``outlive`` at the outer one's."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    within = getattr(_scopes, "open", [])[: -1 if outlive else None]
    if within:
        within[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the folders made inside when it ends; what is still read later has to outlive it."""
    _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield
    finally:
        *_scopes.open, made = _scopes.open
        remove(spark, made)


def release_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage: shuffle files of tables that are written and no longer held go now, not at some time.

    The first round lets go of what Python held, the second of the tables behind it; files go in the background.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared storage."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tasks for each core that write a table of many small partitions.
TASKS_PER_CORE = 4


def materialize(df: DataFrame, name: str, small: bool = False, outlive: bool = False) -> DataFrame:
    """Write to the shared folder as Parquet and read again: cuts lineage and survives a lost executor.

    ``small`` says that the rows are short and cheap to make: partitions are written together, a few files for each core.
    ``outlive`` is as for new_path().
    """
    spark = df.sparkSession
    path = new_path(spark, name, outlive)
    if small:
        df = df.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers on every executor; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="sortilex-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)


#: Bytes of an Arrow batch while a table is written; rows may hold whole texts, and workers hold a few batches.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand Python workers batches of bounded size; the session's own setting holds again afterwards."""
    before = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow by a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
