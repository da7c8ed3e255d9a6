"""WAV files: headers, slices and deletions of samples, all by ranges of bytes.

A file is never read whole for its length: the chunks of its header are walked, and of its samples only the wanted ranges
are read, inside tasks, from the shared file system. Folders are those that Arrow's file systems know (see ``files``).
"""

from __future__ import annotations

import io
import posixpath
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import written
from ..operators.alignment import samples_of
from .files import attempt_of, opened, write_files
from .gridfile import _grid_id

SCHEMA = "grid_id string, sample_rate int, n_samples long, content binary"
#: What ``locate_audio`` gives: ``path`` in the place of the content.
PLACE = "grid_id string, path string, sample_rate int, n_samples long"
#: Bytes of samples that are held at once when ranges are copied from file to file.
PIECE = 1 << 20


@dataclass(frozen=True)
class Header:
    """What a WAV file's header says: the bytes of its format chunk, and where its samples are."""

    form: bytes
    rate: int
    block: int
    start: int
    frames: int


def header_of(f: BinaryIO) -> Header:
    """Walk the chunks up to the samples; raises ValueError for other files. Files above 4 GB (RF64) have their sizes in a chunk of their own."""
    kind, _, wave = struct.unpack("<4sI4s", _exactly(f, 12))
    if kind not in (b"RIFF", b"RF64") or wave != b"WAVE":
        raise ValueError("not a WAV file")
    form, large = None, None
    while True:
        name, size = struct.unpack("<4sI", _exactly(f, 8))
        at = f.tell()
        if name == b"ds64":
            large = struct.unpack("<QQ", _exactly(f, 16))[1]
        elif name == b"fmt ":
            form = _exactly(f, size)
        elif name == b"data":
            if form is None or len(form) < 16:
                raise ValueError("samples without a format")
            rate, block = struct.unpack("<I4xH", form[4:14])
            if not block:
                raise ValueError("samples without a size")
            size = large if size == 0xFFFFFFFF and large is not None else size
            f.seek(0, io.SEEK_END)
            return Header(form, rate, block, at, min(size, f.tell() - at) // block)
        f.seek(at + size + size % 2)


def _exactly(f: BinaryIO, n: int) -> bytes:
    raw = f.read(n)
    if len(raw) < n:
        raise ValueError("the file ends early")
    return raw


def _ranges(head: Header, spans: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """(first, behind last) frames of spans of seconds, inside the file."""
    cut = lambda t: head.frames if t == float("inf") else min(head.frames, max(0, samples_of(t, head.rate)))
    return [(a, b) for a, b in ((cut(lo), cut(hi)) for lo, hi in spans) if a < b]


def copy_frames(f: BinaryIO, head: Header, ranges: list[tuple[int, int]], out: BinaryIO) -> int:
    """Write a WAV file of the ranges of frames, PIECE by PIECE: the number of its frames."""
    frames = sum(b - a for a, b in ranges)
    size = frames * head.block
    if size + len(head.form) + 36 < 1 << 32:
        out.write(struct.pack("<4sI4s", b"RIFF", 20 + len(head.form) + size + size % 2, b"WAVE"))
    else:
        out.write(struct.pack("<4sI4s4sIQQQI", b"RF64", 0xFFFFFFFF, b"WAVE", b"ds64", 28, 56 + len(head.form) + size + size % 2, size, frames, 0))
    out.write(struct.pack("<4sI", b"fmt ", len(head.form)) + head.form + struct.pack("<4sI", b"data", min(size, 0xFFFFFFFF)))
    for a, b in ranges:
        f.seek(head.start + a * head.block)
        left = (b - a) * head.block
        while left:
            raw = _exactly(f, min(PIECE, left))
            out.write(raw)
            left -= len(raw)
    out.write(b"\0" * (size % 2))
    return frames


def _complement(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """What lies outside of spans that are in order and apart."""
    edges, at = [], 0.0
    for lo, hi in spans:
        edges.append((at, lo))
        at = hi
    return [*edges, (at, float("inf"))]


def sliced(raw: bytes, lo: float, hi: float) -> bytes:
    """The samples of [lo, hi) seconds as a WAV file."""
    return _kept(raw, [(lo, hi)])


def without(raw: bytes, spans: list[tuple[float, float]]) -> bytes:
    """All samples but those of the spans, which must be in order and apart."""
    return _kept(raw, _complement(spans))


def _kept(raw: bytes, spans: list[tuple[float, float]]) -> bytes:
    f, out = io.BytesIO(raw), io.BytesIO()
    head = header_of(f)
    copy_frames(f, head, _ranges(head, spans), out)
    return out.getvalue()


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").load(folder)


def locate_audio(spark: SparkSession, folder: str) -> DataFrame:
    """(grid_id, path, sample_rate, n_samples) of the WAV files below ``folder``, from their headers; foreign files get nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for path in batch.column(1).to_pylist():
                system, at = opened(path)
                with system.open_input_file(at) as f:
                    try:
                        head = header_of(f)
                        heads.append((head.rate, head.frames))
                    except ValueError:
                        heads.append((None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([h[0] for h in heads], pa.int32()), pa.array([h[1] for h in heads], pa.int64())], names=["grid_id", "path", "sample_rate", "n_samples"])

    return _files(spark, folder).select(_grid_id(folder).alias("grid_id"), "path").mapInArrow(run, PLACE)


def read_audio(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """(grid_id, sample_rate, n_samples, content) of the WAV files below ``folder``; content, the whole file, only if asked for. Foreign files get nulls."""
    if not with_content:
        return locate_audio(spark, folder).select("grid_id", "sample_rate", "n_samples", F.lit(None).cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for content in batch.column(1):
                try:
                    head = header_of(pa.BufferReader(content.as_buffer()))
                    heads.append((head.rate, head.frames))
                except ValueError:
                    heads.append((None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[0] for h in heads], pa.int32()), pa.array([h[1] for h in heads], pa.int64()), batch.column(1)], names=["grid_id", "sample_rate", "n_samples", "content"])

    return _files(spark, folder).select(_grid_id(folder).alias("grid_id"), "content").mapInArrow(run, SCHEMA)


def _each(rows: DataFrame, make: Callable[[tuple], tuple[str, bytes | None]]) -> DataFrame:
    """SCHEMA from ``make`` of each row: an id and a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, raw = make(row)
                head = header_of(io.BytesIO(raw)) if raw else None
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([head and head.rate], pa.int32()), pa.array([head and head.frames], pa.int64()), pa.array([raw], pa.binary())], names=["grid_id", "sample_rate", "n_samples", "content"])

    return rows.mapInArrow(run, SCHEMA)


def cut_audio(audio: DataFrame, spans: DataFrame) -> DataFrame:
    """Slices of each grid's audio: (grid_id, lo, hi, new_id) gives (grid_id = new_id, sample_rate, n_samples, content).

    ``audio`` has a ``path`` (``locate_audio``; then only the slices are read) or the ``content``.
    """
    if "path" in audio.columns:
        rows = audio.join(spans, "grid_id").select("new_id", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), "path")
        return _each(rows, lambda r: (r[0], _read(r[3], [(r[1], r[2])])))
    rows = audio.join(spans, "grid_id").select("new_id", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), "content")
    return _each(rows, lambda r: (r[0], sliced(r[3], r[1], r[2])))


def _read(path: str, spans: list[tuple[float, float]]) -> bytes:
    """A WAV file of spans of seconds of the file at ``path``."""
    system, at = opened(path)
    out = io.BytesIO()
    with system.open_input_file(at) as f:
        head = header_of(f)
        copy_frames(f, head, _ranges(head, spans), out)
    return out.getvalue()


def _spans_of(spans: DataFrame) -> DataFrame:
    """(grid_id, spans): those of one recording, in order."""
    return spans.groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct(F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi")))).alias("spans"))


def remove_from_audio(audio: DataFrame, spans: DataFrame) -> DataFrame:
    """Audio (with content) without the samples of the spans (grid_id, lo, hi), which must be merged; audio without spans stays.

    Give it ``alignment.usable_spans``, so that audio and intervals lose the same spans.
    """
    rows = audio.select("grid_id", "content").join(_spans_of(spans), "grid_id", "left").select("grid_id", "content", "spans")
    return _each(rows, lambda r: (r[0], without(r[1], [(s["lo"], s["hi"]) for s in r[2]]) if r[1] and r[2] else r[1]))


def save_without(places: DataFrame, spans: DataFrame, folder: str) -> DataFrame:
    """Write each file of ``locate_audio`` without the samples of its spans below ``folder``: (name, frames). Ranges are copied piece by piece, so recordings of any length fit into a task."""
    rows = places.where("n_samples is not null").join(_spans_of(spans), "grid_id", "left").select("grid_id", "path", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = opened(folder)
        for batch in batches:
            done = []
            for grid, path, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, at = opened(path)
                place = f"{base.rstrip('/')}/{grid}.wav"
                target.create_dir(posixpath.dirname(place), recursive=True)
                with system.open_input_file(at) as f, target.open_output_stream(attempt := attempt_of(place)) as out:
                    head = header_of(f)
                    done.append((f"{grid}.wav", copy_frames(f, head, _ranges(head, _complement([(s["lo"], s["hi"]) for s in cut or []])), out)))
                target.move(attempt, place)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["name", "frames"])

    return written(rows.mapInArrow(run, "name string, frames long"))  # the writing happens here, once


def write_audio(audio: DataFrame, folder: str) -> DataFrame:
    """Write the contents as WAV files, named like their grids, inside the tasks: (name, size)."""
    return write_files(audio.select(F.concat(F.col("grid_id").cast("string"), F.lit(".wav")).alias("name"), "content"), folder)
