"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, shared_root

#: Bytes of text handled at once inside a Python worker.
BLOCK_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod


def shared_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    return materialise(df, f"lanemill-{name}")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared root as a path that executors can map into memory.

    The shared root must be mounted (a ``file:`` or plain path); a store that only Spark reads
    cannot be memory-mapped, and is refused with a clear error.
    """
    url = urlparse(shared_root(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory mapping needs a mounted spark.checkpoint.dir, not {url.scheme}:")
    path = f"{unquote(url.path)}/lanemill-{name}-{uuid.uuid4().hex}"
    os.makedirs(path, exist_ok=True)
    atexit.register(shutil.rmtree, path, True)
    return path


#: Rows that a Python worker turns into Python objects at once.
SLICE_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Python takes slices of ``SLICE_ROWS`` anyway; larger batches only stand in memory on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SLICE_ROWS))


def release() -> None:
    """Hand memory that a task no longer needs back to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Called at the end of each task: they drop what a module keeps from one block to the next.
AT_END: list[Callable[[], None]] = []


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` over slices of the batches, so that a large batch is never held as objects as a whole;
    memory is handed back at the end of the task."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield batch.slice(at, SLICE_ROWS)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(sliced(batches))
        end_task()

    return wrapped


def end_task() -> None:
    for forget in AT_END:
        forget()
    release()


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def blocks(sizes: list[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose summed sizes stay near ``limit`` (one long item stands alone)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string or binary Arrow column as UTF-8 bytes, nulls as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(kind)
    return [x or b"" for x in column.to_pylist()]
