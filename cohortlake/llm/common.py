"""Shared helpers of the training-data operators: scratch tables in the
folder that all executors share, and Arrow text access."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of its own only where none is named and
    all runs in this process (tests)."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlake-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their tasks, and
    what one task has once touched would else count beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


#: Bytes of an Arrow batch between Spark and Python; Spark's own 64 MB are held several times over in both.
BATCH_BYTES = "4m"


class Scratch:
    """Tables written to the shared folder, which cut lineage durably.

    A lost executor costs the tasks it was running, never a finished table.
    ``drop`` removes a table that no later plan reads. The session's Arrow
    batches are bounded by ``BATCH_BYTES``, whatever the length of the texts.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        self.spark._jvm.System.gc()  # frees the shuffle files of plans that are done
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its row offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(starts):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``limit`` text bytes: (rows, bytes, offsets). A longer text stands alone."""
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        start = 0
        while start < len(batch):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            end = min(end, len(batch))
            part = offsets[start : end + 1]
            yield batch.slice(start, end - start), data[part[0] : part[-1]], part - part[0]
            start = end
    give_back()


def in_order(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra ones can't clash with internal names."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables in which no group of equal keys is split; rows come sorted by the keys."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1 if len(batch) > 1 else np.zeros(0, int)
        if rest and any(rest[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(rest)
            rest = []
        if len(cut):
            yield pa.Table.from_batches([*rest, batch.slice(0, int(cut[-1]))])
            rest = []
            batch = batch.slice(int(cut[-1]))
        rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)
    give_back()
