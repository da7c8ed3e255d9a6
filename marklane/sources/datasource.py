"""Annotation files as a Spark data source: ``spark.read.format("annotations")`` and ``df.write.format("annotations")``.

Reading: input partitions are planned by file sizes; equality, membership and prefix filters on grid_id choose files before any is opened,
those on tier_name choose tiers while a file is parsed. Writing: a task writes its files under a folder of its own
attempt, moves them to their places when all are whole and gives a message that names the list of its files; ``commit``
removes the lists, ``abort`` removes what they name. Nothing about single files comes to the driver, but for the listing that reading plans by.

Option path: a local or shared folder, or a URI that Arrow's file systems know (``gridfile.read_grids`` reads any that Spark knows).
Other options: encoding (utf-8), partitionBytes (64 MB).
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from . import gridfile
from .files import opened

NAME = "annotations"
_FILE = re.compile(r"\.textgrid$", re.IGNORECASE)
_STAGED = "_staged-"


def register(spark: SparkSession) -> None:
    """Make the source known to a session and let filters reach it (spark.sql.python.filterPushdown.enabled)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AnnotationSource)


def load(spark: SparkSession, folder: str, encoding: str = "utf-8") -> DataFrame:
    """The rows (``gridfile.SCHEMA``) of the files below ``folder``."""
    register(spark)
    return spark.read.format(NAME).option("encoding", encoding).load(folder)


def save(rows: DataFrame, folder: str, encoding: str = "utf-8") -> None:
    """Write a file for each grid below ``folder``; files of other grids stay."""
    register(rows.sparkSession)
    gridfile.in_files(rows).write.format(NAME).mode("append").option("encoding", encoding).save(folder)


class AnnotationSource(DataSource):
    """Mode append replaces the files of the grids it writes and leaves the others; overwrite removes all annotation files below the folder first."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return gridfile.SCHEMA

    def reader(self, schema: StructType) -> AnnotationReader:
        return AnnotationReader(self._folder(), self.options.get("encoding", "utf-8"), int(self.options.get("partitionBytes", 64 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> AnnotationWriter:
        if missing := [c for c in gridfile.FILE_COLUMNS if c not in schema.fieldNames()]:
            raise ValueError(f"columns are missing: {missing}")
        folder = self._folder()
        if overwrite:
            system, _ = opened(folder)
            for _, path, _ in listed(folder):
                system.delete_file(path)
        return AnnotationWriter(folder, self.options.get("encoding", "utf-8"), uuid.uuid4().hex)

    def _folder(self) -> str:
        if not self.options.get("path"):
            raise ValueError("no path is given")
        return self.options["path"].rstrip("/")


def listed(folder: str) -> Iterator[tuple[str, str, int]]:
    """(grid_id, path, bytes) of the annotation files below ``folder``, those of unfinished writes left out."""
    system, base = opened(folder)
    base = base.rstrip("/")
    for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
        below = f.path[len(base) + 1 :]
        if f.type == fs.FileType.File and _FILE.search(f.path) and not below.startswith(_STAGED):
            yield _FILE.sub("", below), f.path, f.size


@dataclass
class _Files(InputPartition):
    """(grid_id, path) of the files that one task reads."""

    files: list[tuple[str, str]]


class AnnotationReader(DataSourceReader):
    def __init__(self, folder: str, encoding: str, partition_bytes: int):
        "".encode(encoding)
        self.folder, self.encoding, self.partition_bytes = folder, encoding, partition_bytes
        self.grids: set[str] | None = None
        self.prefixes: list[str] = []
        self.tiers: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps what it can answer exactly; the others are Spark's."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("grid_id",):
                self.grids = values if self.grids is None else self.grids & values
            elif values is not None and f.attribute == ("tier_name",):
                self.tiers = values if self.tiers is None else self.tiers & values
            elif isinstance(f, StringStartsWith) and f.attribute == ("grid_id",):
                self.prefixes.append(f.value)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Files in order of their ids, as many to a partition as ``partitionBytes`` holds; a larger file is one."""
        out: list[_Files] = []
        room = 0
        for grid, path, size in sorted(listed(self.folder)):
            if (self.grids is not None and grid not in self.grids) or not all(map(grid.startswith, self.prefixes)):
                continue
            if not out or room < size:
                out.append(_Files([]))
                room = self.partition_bytes
            out[-1].files.append((grid, path))
            room -= size
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)

        def contents() -> Iterator[tuple[str, bytes]]:
            for grid, path in partition.files:
                with system.open_input_stream(path) as f:
                    yield grid, f.read()

        return gridfile.rows_of(contents(), self.encoding, self.tiers)


@dataclass
class _Done(WriterCommitMessage):
    """What one task wrote: the list with the names of its files, their number and bytes."""

    names: str
    files: int
    size: int


class AnnotationWriter(DataSourceArrowWriter):
    """Rows of a grid must follow each other in one task (``gridfile.in_files``)."""

    def __init__(self, folder: str, encoding: str, job: str):
        "".encode(encoding)
        self.folder, self.encoding, self.job = folder, encoding, job

    def _staged(self) -> tuple[fs.FileSystem, str, str]:
        system, base = opened(self.folder)
        return system, base.rstrip("/"), f"{base.rstrip('/')}/{_STAGED}{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        system, base, staged = self._staged()
        context = TaskContext.get()
        own = f"{staged}/{context.partitionId() if context else 0}-{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        size, n = 0, 0
        with system.open_output_stream(f"{own}.names") as names:
            for grid, text in gridfile.files_in(iterator):
                raw = text.encode(self.encoding)
                with system.open_output_stream(f"{own}/{n}") as out:
                    out.write(raw)
                names.write(f"{grid}\n".encode())
                size, n = size + len(raw), n + 1
        folders = set()
        with system.open_input_stream(f"{own}.names") as f:
            for k, line in enumerate(_lines(f)):
                path = f"{base}/{line}.TextGrid"
                if (parent := posixpath.dirname(path)) not in folders:
                    system.create_dir(parent, recursive=True)
                    folders.add(parent)
                system.move(f"{own}/{k}", path)
        return _Done(f"{own}.names", n, size)

    def commit(self, messages: list[_Done | None]) -> None:
        system, _, staged = self._staged()
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)

    def abort(self, messages: list[_Done | None]) -> None:
        """Files of tasks that had finished go; a file that they replaced is not brought back."""
        system, base, staged = self._staged()
        for m in messages:
            if m is not None and system.get_file_info(m.names).type == fs.FileType.File:
                with system.open_input_stream(m.names) as f:
                    for line in _lines(f):
                        path = f"{base}/{line}.TextGrid"
                        if system.get_file_info(path).type == fs.FileType.File:
                            system.delete_file(path)
        self.commit(messages)


def _lines(f) -> Iterator[str]:
    """The lines of a stream; grid ids hold no line breaks, as they are file names."""
    rest = b""
    while part := f.read(1 << 20):
        *whole, rest = (rest + part).split(b"\n")
        for line in whole:
            yield line.decode()
