"""Annotation text files as Spark tables.

Files are read as binary rows and parsed inside tasks, one file at a time; the
result is the flat interval table. Both layouts of the format are read: the long
one, where a value follows ``name =``, and the short one, where values stand
alone. Written files have the long layout.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import written
from ..operators.validation import invalid_grids
from .files import copy_files

# Fixed values of the file format.
SUFFIX_GLOB = "*.[tT][eE][xX][tT][gG][rR][iI][dD]"
_HEADER, _CLASS = "ooTextFile", "TextGrid"
_TOKEN = re.compile(r'"((?:[^"]|"")*)"|<exists>|<absent>|(?<![\w\[.])([-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)(?![\w\].])')

SCHEMA = "grid_id string, tier_idx int, tier_name string, kind string, idx long, t0 double, t1 double, mark string, grid_t0 double, grid_t1 double, error string"


def _values(text: str) -> Iterator[tuple[str, str]]:
    """('text', value) or ('number', value) in order; labels, brackets and flags are passed over."""
    for m in _TOKEN.finditer(text):
        if m[1] is not None:
            yield "text", m[1].replace('""', '"')
        elif m[2] is not None:
            yield "number", m[2]


def parse(text: str) -> dict:
    """{'t0', 't1', 'tiers': [{'name', 'kind', 't0', 't1', 'rows': [(t0, t1, mark)]}]}; raises ValueError for other files.

    Intervals that do not last are left out. Points are rows with equal times.
    """
    values = _values(text)

    def take(kind: str) -> str:
        for k, v in values:
            if k == kind:
                return v
        raise ValueError("the file ends early")

    if not take("text").startswith(_HEADER) or take("text") != _CLASS:
        raise ValueError("not an annotation file")
    out = {"t0": float(take("number")), "t1": float(take("number")), "tiers": []}
    for _ in range(int(float(take("number")))):
        kind, name = take("text"), take("text")
        tier = {"name": name, "kind": "interval" if kind == "IntervalTier" else "point", "t0": float(take("number")), "t1": float(take("number")), "rows": []}
        for _ in range(int(float(take("number")))):
            t0 = float(take("number"))
            t1 = float(take("number")) if tier["kind"] == "interval" else t0
            mark = take("text")
            if tier["kind"] == "point" or t0 < t1:
                tier["rows"].append((t0, t1, mark))
        out["tiers"].append(tier)
    return out


def list_files(spark: SparkSession, folder: str, glob: str = SUFFIX_GLOB) -> DataFrame:
    """(grid_id, path, length): files below a folder; grid_id is the path below it without suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select(_grid_id(folder).alias("grid_id"), "path", "length")


def _grid_id(folder: str):
    base = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    below = F.element_at(F.split("path", "\\Q" + base + "\\E/", 2), -1)
    return F.regexp_replace(below, r"\.[^./]*$", "")


TASKS_JOINED, TASKS_PER_CORE = 8, 4  # so many of Spark's input partitions become one, but for each core there stay so many


def read_grids(spark: SparkSession, folder: str, encoding: str = "utf-8") -> DataFrame:
    """All tiers and intervals of the files below ``folder`` (SCHEMA).

    A tier without intervals gives one row with a null idx, a file that cannot be read one row with its error.
    """
    "".encode(encoding)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", SUFFIX_GLOB).load(folder)
    # Spark counts some MB for opening a file, so a task would take some thirty small ones and spend its time on being started
    tasks, least = files.select("path").rdd.getNumPartitions(), TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    return parsed(files.coalesce(max(-(-tasks // TASKS_JOINED), min(tasks, least), 1)), folder, encoding)


def parsed(files: DataFrame, folder: str, encoding: str) -> DataFrame:
    """The rows (SCHEMA) of the files (path, content) below ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows_of(((grid.as_py(), raw.as_py()) for batch in batches for grid, raw in zip(batch.column(0), batch.column(1), strict=True)), encoding)

    return files.select(_grid_id(folder).alias("grid_id"), "content").mapInArrow(run, SCHEMA)


_NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]
_KINDS = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.string()]


# Small files share a batch until it has so many rows, or its files so many bytes; a larger file is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 10_000, 1 << 20


def rows_of(files: Iterable[tuple[str, bytes]], encoding: str, tiers: set[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The rows (SCHEMA) of files (grid_id, content); of the tiers of these names, if given."""
    rows, size = [], 0
    for grid, raw in files:
        if rows and size + len(raw) > BATCH_BYTES:
            yield _batch(rows)
            rows, size = [], 0
        try:
            found = list(_rows(grid, parse(raw.decode(encoding))))
        except (ValueError, UnicodeError) as e:
            found = [(grid, *[None] * 9, str(e))]
        rows += found if tiers is None else [r for r in found if r[2] in tiers]
        size += len(raw)
        if len(rows) >= BATCH_ROWS:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def _rows(grid: str, found: dict) -> Iterator[tuple]:
    for k, tier in enumerate(found["tiers"]):
        head, tail = (grid, k, tier["name"], tier["kind"]), (found["t0"], found["t1"], None)
        if not tier["rows"]:
            yield (*head, None, tier["t0"], tier["t1"], None, *tail)
        for i, (t0, t1, mark) in enumerate(tier["rows"]):
            yield (*head, i, t0, t1, mark, *tail)


def intervals(rows: DataFrame) -> DataFrame:
    """The interval table of what ``read_grids`` gives."""
    return rows.where("kind = 'interval' and idx is not null").select("grid_id", "tier_idx", "tier_name", "idx", "t0", "t1", "mark")


def points(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'point' and idx is not null").select("grid_id", "tier_idx", "tier_name", "idx", F.col("t0").alias("t"), "mark")


def number(value: float) -> str:
    """A whole number without a fraction, any other as Python prints it."""
    return str(int(value)) if value == int(value) else repr(float(value))


def _quoted(text: str | None) -> str:
    return '"' + (text or "").replace('"', '""') + '"'


def _tier_lines(k: int, name: str, kind: str, rows: list[tuple[float, float, str]], lo: float, hi: float) -> list[str]:
    """A tier of a file. Gaps between intervals are filled with empty ones; point tiers have points."""
    head = [f"    item [{k}]:", f'        class = "{"IntervalTier" if kind == "interval" else "TextTier"}" ', f"        name = {_quoted(name)} ", f"        xmin = {number(lo)} ", f"        xmax = {number(hi)} "]
    if kind == "point":
        out = [*head, f"        points: size = {len(rows)} "]
        for i, (t, _, mark) in enumerate(rows, 1):
            out += [f"        points [{i}]:", f"            number = {number(t)} ", f"            mark = {_quoted(mark)} "]
        return out
    filled, at = [], lo
    for t0, t1, mark in [*rows, (hi, hi, "")]:
        if at < t0:
            filled.append((at, t0, ""))
        if t0 < t1:
            filled.append((t0, t1, mark))
        at = t1
    out = [*head, f"        intervals: size = {len(filled)} "]
    for i, (t0, t1, mark) in enumerate(filled, 1):
        out += [f"        intervals [{i}]:", f"            xmin = {number(t0)} ", f"            xmax = {number(t1)} ", f"            text = {_quoted(mark)} "]
    return out


#: The columns of a file's rows, in the order in which ``compose`` takes them.
FILE_COLUMNS = ["grid_id", "tier_idx", "tier_name", "kind", "idx", "t0", "t1", "mark", "grid_t0", "grid_t1"]


def compose(rows: list[tuple]) -> str:
    """The text of one file from its rows (FILE_COLUMNS), which are sorted by tier and idx."""
    spans = [(r[8], r[9]) for r in rows if r[8] is not None] or [(r[5], r[6]) for r in rows]
    lo, hi = min(a for a, _ in spans), max(b for _, b in spans)
    tiers = [list(g) for _, g in groupby(rows, key=lambda r: r[1])]
    out = [f'File type = "{_HEADER}"', f'Object class = "{_CLASS}"', "", f"xmin = {number(lo)} ", f"xmax = {number(hi)} ", "tiers? <exists> ", f"size = {len(tiers)} ", "item []: "]
    for k, tier in enumerate(tiers, 1):
        out += _tier_lines(k, tier[0][2], tier[0][3], [(r[5], r[6], r[7] or "") for r in tier if r[4] is not None], lo, hi)
    return "\n".join(out) + "\n"


def in_files(rows: DataFrame) -> DataFrame:
    """FILE_COLUMNS of an interval table, or of what ``read_grids`` gives, with the rows of a file together and in order; rows with an error are left out."""
    if "kind" not in rows.columns:
        rows = rows.withColumns({"kind": F.lit("interval"), "grid_t0": F.lit(None).cast("double"), "grid_t1": F.lit(None).cast("double"), "error": F.lit(None).cast("string")})
    typed = {c: F.col(c).cast("double") for c in ("t0", "t1", "grid_t0", "grid_t1")}
    rows = rows.where("error is null").withColumns({**typed, "grid_id": F.col("grid_id").cast("string"), "tier_idx": F.col("tier_idx").cast("int"), "idx": F.col("idx").cast("long")})
    return rows.select(*FILE_COLUMNS).repartition("grid_id").sortWithinPartitions("grid_id", "tier_idx", "idx")


def files_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    """(grid_id, text) of the files whose rows (FILE_COLUMNS) follow each other; one file is held at a time."""
    rows = (r for batch in batches for r in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in FILE_COLUMNS), strict=True))
    for grid, of in groupby(rows, key=lambda r: r[0]):
        yield grid, compose(list(of))


def to_texts(rows: DataFrame) -> DataFrame:
    """(grid_id, text): each grid as a file's text, long layout.

    ``rows`` is an interval table, or what ``read_grids`` gives: then point tiers, tiers without intervals and the grid's own
    span are kept, and rows with an error are left out. Null marks are written as empty texts.
    Rows of a grid are brought together and stream through; a task holds one file at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grid, text in files_in(batches):
            yield pa.RecordBatch.from_arrays([pa.array([grid]), pa.array([text])], names=["grid_id", "text"])

    return in_files(rows).mapInArrow(run, "grid_id string, text string")


def write_grids(rows: DataFrame, folder: str, changed: DataFrame | None = None, overwrite: bool = True, dry: bool = False, unchanged_from: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """Write one file for each grid, named like it, inside the tasks: (grid_id, outcome, error), a row per grid.

    Outcomes: ``written``; ``invalid`` (see ``validation.invalid_grids``; such grids are not written); ``exists`` (without ``overwrite``, files that are
    there stay); ``unchanged`` (not in ``changed`` (grid_id), where that is given), or ``copied`` if ``unchanged_from`` names the folder of
    the source files. With ``dry`` nothing is written and the outcomes are those that a run would have.
    """
    spark = rows.sparkSession
    taken = [F.col(c).cast("string") if c == "grid_id" or kind == "void" else F.col(c) for c, kind in rows.dtypes if c in (*FILE_COLUMNS, "error")]
    rows = written(rows.select(*taken))  # used three times: what it takes to make them, such as reading files, is done once
    held = rows if "kind" not in rows.columns else intervals(rows)
    grids = rows.select("grid_id").distinct().join(invalid_grids(held), "grid_id", "left")
    try:
        there = list_files(spark, folder).select("grid_id").withColumn("_there", F.lit(True)) if not overwrite else None
    except AnalysisException:  # no such folder yet
        there = None
    grids = grids.join(there, "grid_id", "left") if there is not None else grids.withColumn("_there", F.lit(None).cast("boolean"))
    touched = changed.select(F.col("grid_id").cast("string").alias("grid_id")).distinct().withColumn("_new", F.lit(True)) if changed is not None else grids.select("grid_id", F.lit(True).alias("_new"))
    rest = "copied" if unchanged_from else "unchanged"
    outcome = F.when(F.col("error").isNotNull(), "invalid").when(F.col("_there"), "exists").when(F.col("_new").isNull(), rest).otherwise("written")
    plan = written(grids.join(touched, "grid_id", "left").select("grid_id", outcome.alias("outcome"), "error"))  # decided before the first file changes
    if dry:
        return plan
    from .datasource import save

    name = F.concat("grid_id", F.lit(f".{_CLASS}")).alias("name")
    save(rows.join(plan.where("outcome = 'written'"), "grid_id", "left_semi"), folder, encoding)
    if unchanged_from:
        source = list_files(spark, unchanged_from).join(plan.where("outcome = 'copied'"), "grid_id", "left_semi")
        copy_files(source.select("path", name), folder)
    return plan
