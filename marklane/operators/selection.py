"""Choosing intervals and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import COLUMNS, KEY, duration, in_marks, of_tiers, text_of
from .lookup import asof
from .regex import found


def tiers_named(intervals: DataFrame, names: list[str]) -> DataFrame:
    return intervals.where(of_tiers(intervals, names))


def single_tier(intervals: DataFrame, name: str) -> DataFrame:
    """The intervals of the one tier of that name; grids without such a tier or with several give none (``validation.tier_errors`` names them)."""
    of = tiers_named(intervals, [name])
    whole = W.partitionBy("grid_id")
    return of.withColumns({"_lo": F.min("tier_idx").over(whole), "_hi": F.max("tier_idx").over(whole)}).where("_lo = _hi").drop("_lo", "_hi")


def with_marks(intervals: DataFrame, marks: list[str]) -> DataFrame:
    """Intervals with one of the marks; all of them if none is given."""
    return intervals.where(in_marks(marks)) if marks else intervals


def without_marks(intervals: DataFrame, marks: list[str]) -> DataFrame:
    return intervals.where(~in_marks(marks))


def considered(intervals: DataFrame, marks: list[str], mode: str = "consider") -> DataFrame:
    """Intervals with one of the marks (``consider``) or with none of them (``ignore``)."""
    if mode not in ("consider", "ignore"):
        raise ValueError(f"no such mode: {mode}")
    return intervals.where(in_marks(marks) if mode == "consider" else ~in_marks(marks))


def lasting(intervals: DataFrame, shortest: float, longest: float) -> DataFrame:
    """Durations from ``shortest`` to below ``longest``."""
    return intervals.where((duration() >= shortest) & (duration() < longest))


def very_short(intervals: DataFrame, threshold: float = 0.002) -> DataFrame:
    return intervals.where(duration() < threshold)


def contained(intervals: DataFrame, lo: float, hi: float) -> DataFrame:
    return intervals.where((F.col("t0") >= lo) & (F.col("t1") <= hi))


def part_of(intervals: DataFrame, lo: float, hi: float) -> DataFrame:
    """Intervals that start in [lo, hi) or end in (lo, hi]; one that covers the whole span from outside does neither."""
    return intervals.where(((F.col("t0") >= lo) & (F.col("t0") < hi)) | ((F.col("t1") > lo) & (F.col("t1") <= hi)))


def last_span(intervals: DataFrame, spans: DataFrame, out: str = "_span", width: float | None = None) -> DataFrame:
    """Append ``out``, the struct of the columns of the last span (grid_id, lo, ...) of the grid that starts at or before the interval; null if none does.

    See ``lookup.asof``, also for ``width``.
    """
    return asof(intervals, spans, ["grid_id"], F.col("t0"), "lo", out, width=width)


def within_spans(intervals: DataFrame, spans: DataFrame, width: float | None = None) -> DataFrame:
    """Intervals that lie in a span (grid_id, lo, hi, ...), with the span's columns. The spans of a grid must not overlap."""
    of = [c for c in spans.columns if c != "grid_id"]
    hit = last_span(intervals, spans, width=width).where(F.col("t1") <= F.col("_span.hi"))
    return hit.select(*intervals.columns, *[F.col("_span")[c].alias(c) for c in of])


def filling(intervals: DataFrame, spans: DataFrame) -> DataFrame:
    """Intervals contained in a span (grid_id, lo, hi) whose contained intervals reach exactly from edge to edge of it, on each tier. Spans of a grid must not overlap."""
    inside = within_spans(intervals, spans)
    by = W.partitionBy(*KEY, "lo", "hi")
    return inside.withColumn("_a", F.min("t0").over(by)).withColumn("_b", F.max("t1").over(by)).where((F.col("_a") == F.col("lo")) & (F.col("_b") == F.col("hi"))).drop("_a", "_b")


def positional(intervals: DataFrame, hit: Column, mode: str, out: str = "_chosen") -> DataFrame:
    """Append ``out``: whether ``hit`` holds for the row and, but for mode ``all``, for all rows from it to the ``start`` (``begin``), the ``end`` or an end of ``both`` of its tier."""
    if mode == "all":
        return intervals.withColumn(out, F.coalesce(hit, F.lit(False)))
    whole = W.partitionBy(*KEY)
    miss = F.when(~hit, F.col("idx"))
    first, last = F.coalesce(F.min(miss).over(whole), F.max("idx").over(whole) + 1), F.coalesce(F.max(miss).over(whole), F.lit(-1))
    rows = intervals.withColumns({"_lo": first, "_hi": last})
    chosen = {"start": F.col("idx") < F.col("_lo"), "end": F.col("idx") > F.col("_hi")}
    chosen["begin"], chosen["both"] = chosen["start"], chosen["start"] | chosen["end"]
    if mode not in chosen:
        raise ValueError(f"no such mode: {mode}")
    return rows.withColumn(out, chosen[mode]).drop("_lo", "_hi")


def _positional(intervals: DataFrame, hit: Column, mode: str) -> DataFrame:
    return positional(intervals, hit, mode).where("_chosen").drop("_chosen")


def at_ends(intervals: DataFrame, marks: list[str], mode: str = "all") -> DataFrame:
    """Intervals with one of the marks: all, the run at a tier's ``start``, at its ``end``, or ``both``."""
    return _positional(intervals, in_marks(marks), mode)


def matching(intervals: DataFrame, pattern: str, mode: str = "all") -> DataFrame:
    """The same for marks in which a regular expression (Python's; see ``regex``) is found."""
    return _positional(intervals.withColumn("_found", found(pattern)(text_of())), F.col("_found"), mode).drop("_found")


def remove_tiers(intervals: DataFrame, names: list[str]) -> DataFrame:
    """Drop all tiers of the names and number the rest anew. A grid that would lose all of its tiers keeps them (an error row in ``validation.results``)."""
    hit = of_tiers(intervals, names)
    marked = intervals.withColumn("_hit", hit).withColumn("_all", F.min(F.col("_hit").cast("int")).over(W.partitionBy("grid_id")))
    kept = marked.where(~F.col("_hit") | (F.col("_all") == 1)).drop("_hit", "_all")
    rank = F.dense_rank().over(W.partitionBy("grid_id").orderBy("tier_idx")) - 1
    return kept.withColumn("tier_idx", rank.cast(intervals.schema["tier_idx"].dataType)).select(*COLUMNS)
