"""Writing and copying named files inside tasks.

A file is written under a name of its own attempt and then moved to its place, so
a task that runs again, or twice at once, leaves one whole file. Folders are local or shared paths or URIs that Arrow's file
systems know.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import written


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    return fs.LocalFileSystem(), folder


def attempt_of(path: str) -> str:
    """The name under which a task attempt writes what is to be moved to ``path``."""
    context = TaskContext.get()
    return f"{path}.{context.taskAttemptId() if context else 0}-{uuid.uuid4().hex}"


def put(system: fs.FileSystem, path: str, content: bytes) -> None:
    """A whole file at ``path`` or none."""
    attempt = attempt_of(path)
    system.create_dir(posixpath.dirname(path), recursive=True)
    with system.open_output_stream(attempt) as out:
        out.write(content)
    system.move(attempt, path)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write ``content`` (binary) to the path ``name`` below ``folder``: (name, size) of the files written. Null contents are passed over; equal names: one of them stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        for batch in batches:
            done = []
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                if content.is_valid:
                    raw = content.as_py()
                    put(system, f"{base.rstrip('/')}/{name.as_py()}", raw)
                    done.append((name.as_py(), len(raw)))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["name", "size"])

    return written(files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, size long"))  # the writing happens here, once


def copy_files(paths: DataFrame, folder: str, order: str = "path") -> DataFrame:
    """Copy each ``path`` to ``name`` below ``folder``: (name, size). Nothing is copied if some path cannot be read: then ValueError names the first by ``order``."""
    rows = paths.select("path", "name", F.col(order).alias("_order"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            readable = []
            for path in batch.column(0).to_pylist():
                system, at = opened(path) if path else (None, None)
                readable.append(system is not None and system.get_file_info(at).type == fs.FileType.File)
            yield batch.filter(pa.array([not r for r in readable], pa.bool_()))

    if lost := rows.mapInArrow(look, rows.schema).orderBy("_order").first():
        raise ValueError(f"cannot be read: {lost['path']}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = opened(path)
                with system.open_input_stream(at) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([f.read()], pa.binary())], names=["name", "content"])

    return write_files(rows.mapInArrow(read, "name string, content binary"), folder)
