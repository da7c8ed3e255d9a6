"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Text bytes that one step of an Arrow function handles at once, and that Spark puts into a batch for it; a longer single text is one step.
SLICE_BYTES = 4 << 20


def scratch(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that the driver and all executors share.

    Where the setting is absent (local tests) a folder in the warehouse is set and used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()  # set by an earlier call
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in replicated files.

    Unlike a checkpoint, the files have a known size, so later joins are planned by it and small parts are read together.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: int | None, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose texts in ``column`` have about ``limit`` bytes; all rows, in order."""
    if column is None or batch.num_rows <= 1:
        yield batch
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // limit
    edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task holds no buffers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def map_rows(df: DataFrame, make: Callable, fields: list[T.StructField], text: str | None = None, drop: tuple[str, ...] = (), step: int = SLICE_BYTES) -> DataFrame:
    """Append ``fields`` to every row; ``make()`` gives a function from a record batch to the new arrays.

    Columns of ``df`` named like a new field or in ``drop`` give way; all others pass unchanged.
    What ``make()`` sets up (caches of words or pieces) belongs to one task and goes with it. A call gets texts of about
    ``step`` bytes. The session's batches are bounded alike: 10,000 long rows at once would be held on both sides, in every task.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", max(step, SLICE_BYTES))
    new = {f.name for f in fields}
    keep = [i for i, f in enumerate(df.schema.fields) if f.name not in new and f.name not in drop]
    names = [df.schema.fields[i].name for i in keep] + [f.name for f in fields]
    at = df.columns.index(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, at, step):
                yield pa.RecordBatch.from_arrays([part.column(i) for i in keep] + list(fn(part)), names=names)
        del fn
        release()

    return df.mapInArrow(run, T.StructType([df.schema.fields[i] for i in keep] + list(fields)))


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    """The texts of a column; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
