"""Vocabularies, durations and mark statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import COLUMNS, KEY, duration, in_marks, text_of, written
from .marks import assign_from
from .orderstats import at_ranks
from .regex import literal


def vocabulary(intervals: DataFrame, ignore: list[str] = ("", " ")) -> DataFrame:
    """(mark, n): distinct marks and how often they occur; sort by mark for the code point order."""
    return intervals.where(~in_marks(list(ignore))).groupBy(text_of().alias("mark")).agg(F.count(F.lit(1)).alias("n"))


def grid_durations(intervals: DataFrame) -> DataFrame:
    """(grid_id, duration) from first start to last end."""
    return intervals.groupBy("grid_id").agg((F.max("t1") - F.min("t0")).alias("duration"))


def duration_stats(durations: DataFrame, column: str = "duration") -> DataFrame:
    """One row: number, min, median, max, mean, population deviation and kurtosis (Fisher, biased), sum. The median is exact (``orderstats``); without durations there is no row."""
    d = F.col(column)
    durations = written(durations.select(d.alias(column)))
    rest = durations.agg(F.count(d).alias("n"), F.min(d).alias("shortest"), F.max(d).alias("longest"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"), F.kurtosis(d).alias("kurtosis"), F.sum(d).alias("total"))
    middle = at_ranks(durations, [], column, [lambda n: F.floor((n - 1) / 2), lambda n: F.ceil((n - 1) / 2)])
    median = (F.col("stats")[0].cast("double") + F.col("stats")[1].cast("double")) / 2
    out = rest.join(middle.select("n", median.alias("median")), "n")
    return out.select("n", "shortest", "median", "longest", "mean", "sd", "kurtosis", "total")


def marks_table(intervals: DataFrame) -> DataFrame:
    """(tier_name, mark, n, percent): counts of marks in tiers of a name, and a row with a null mark for their total."""
    counts = intervals.groupBy("tier_name", text_of().alias("mark")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("tier_name").agg(F.sum("n").alias("n")).select("tier_name", F.lit(None).cast("string").alias("mark"), "n", F.lit(100.0).alias("percent"))
    share = F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("tier_name"))
    return counts.withColumn("percent", share).unionByName(total)


def tier_stats(intervals: DataFrame) -> DataFrame:
    """Number, shortest, longest and mean duration of each tier's intervals."""
    d = duration()
    return intervals.groupBy(*KEY, "tier_name").agg(F.count(F.lit(1)).alias("n"), F.min(d).alias("shortest"), F.max(d).alias("longest"), F.avg(d).alias("mean"))


def symbol_table(intervals: DataFrame) -> DataFrame:
    """(grid_id, tier_idx, mark, n, rank): marks of each tier by falling count, then first occurrence."""
    counts = intervals.groupBy(*KEY, text_of().alias("mark")).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("_first"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("n"), "_first"))).drop("_first")


def marks_text(intervals: DataFrame, sep: str = "|") -> DataFrame:
    """(grid_id, tier_idx, text): marks in order, escaped as in a Python string literal without quotes, joined by ``sep``."""
    rows = intervals.withColumn("_m", literal(text_of()))
    marks = F.transform(F.array_sort(F.collect_list(F.struct("idx", "_m"))), lambda x: x["_m"])
    return rows.groupBy(*KEY).agg(F.array_join(marks, sep).alias("text"))


def violin_data(intervals: DataFrame, by: str = "mark") -> DataFrame:
    """(by, duration, n): how often each mark or tier has each duration, for plotting; no group of rows is brought together."""
    return intervals.groupBy(F.coalesce(F.col(by), F.lit("")).alias(by), duration().alias("duration")).agg(F.count(F.lit(1)).alias("n"))


def duration_bounds(intervals: DataFrame, scope: list[str], lo: float, hi: float, range_mode: str = "percentile", per_mark: bool = True, min_count: int = 1) -> DataFrame:
    """(scope..., [mark], n, lo, hi): cut-offs of the durations of each scope (and mark) with ``min_count`` intervals.

    ``percent``: of the longest duration. ``percentile``: of the distribution. ``absolute``: as given. Infinite stays.
    The distribution of a group is reduced to (duration, count) pairs, and only the ranges around its cut-offs are brought together.
    """
    keys = [*scope, *(["mark"] if per_mark else [])]
    rows = intervals.withColumn("mark", text_of()).withColumn("_d", duration())
    if range_mode == "absolute":
        out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumns({"lo": F.lit(float(lo)), "hi": F.lit(float(hi))})
    elif range_mode == "percent":
        cut = lambda v: F.lit(math.inf) if v == math.inf else F.max("_d") / 100.0 * v
        out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), cut(lo).alias("lo"), cut(hi).alias("hi"))
    elif range_mode == "percentile":
        out = _percentiles(rows, keys, lo, hi)
    else:
        raise ValueError(f"no such mode: {range_mode}")
    return out.where(F.col("n") >= min_count)


def _percentiles(rows: DataFrame, keys: list[str], lo: float, hi: float) -> DataFrame:
    """Percentiles with linear interpolation between the two order statistics around each position (``orderstats``)."""
    asked = [(name, p) for name, p in (("lo", lo), ("hi", hi)) if p != math.inf]
    ranks = []
    for _, p in asked:
        ranks += [lambda n, p=p: F.floor((n - 1) * F.lit(p / 100)), lambda n, p=p: F.least(F.floor((n - 1) * F.lit(p / 100)) + 1, n - 1)]
    out = at_ranks(rows, keys, "_d", ranks or [lambda n: F.lit(0)])
    bounds = {name: F.lit(math.inf) for name in ("lo", "hi")}
    for i, (name, p) in enumerate(asked):
        pos = (F.col("n") - 1) * F.lit(p / 100)
        t, a, b = pos - F.floor(pos), F.col("stats")[2 * i].cast("double"), F.col("stats")[2 * i + 1].cast("double")
        bounds[name] = F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t)
    return out.select(*keys, "n", bounds["lo"].alias("lo"), bounds["hi"].alias("hi"))


def _with_bounds(considered: DataFrame, scope: list[str], lo: float, hi: float, range_mode: str = "percentile", per_mark: bool = True, min_count: int = 1) -> DataFrame:
    """Intervals of one tier whose scope (and mark) has ``min_count`` of them, with its cut-offs lo and hi. Without a scope the tier's name is one."""
    keys = list(scope) if scope or per_mark else ["tier_name"]
    bounds = duration_bounds(considered, keys, lo, hi, range_mode, per_mark, min_count)
    return considered.withColumn("mark", text_of()).join(bounds, [*keys, *(["mark"] if per_mark else [])])


def select_durations(intervals: DataFrame, tier: str, marks: list[str], scope: list[str], lo: float, hi: float, range_mode: str = "percentile", per_mark: bool = True, min_count: int = 1) -> DataFrame:
    """Intervals of a tier with one of the marks (any, if none is given) whose duration lies in [lo, hi) of its distribution."""
    rows = intervals.where(F.col("tier_name") == tier)
    rows = rows.where(in_marks(marks)) if marks else rows
    bounded = _with_bounds(rows, scope, lo, hi, range_mode, per_mark, min_count)
    return bounded.where((duration() >= F.col("lo")) & (duration() < F.col("hi"))).select(*COLUMNS)


def label_durations(intervals: DataFrame, tier: str, assign_tier: str, mark: str, marks: list[str], scope: list[str], lo: float, hi: float, **how) -> DataFrame:
    """Mark, on ``assign_tier``, the intervals of the same times as the selected ones of ``tier``."""
    return assign_from(intervals, tier, assign_tier, select_durations(intervals, tier, marks, scope, lo, hi, **how), mark)


def label_counts(intervals: DataFrame, tier: str, assign_tier: str, mark: str, marks: list[str], scope: list[str], lo: float, hi: float, range_mode: str = "percentile", per_mark: bool = True, min_count: int = 1) -> DataFrame:
    """(counter, n) of a labelling: ``total`` intervals of the tier, ``considered`` ones with one of the marks, those whose
    scope has ``enough`` of them, those of ``matching`` duration, and the marks ``changed`` on ``assign_tier``.

    Each interval of the tier is judged once and written with its flags; the first four are sums over those, the last is counted
    on ``assign_tier`` by a semi join with the times of the matching ones."""
    rows = intervals.where(F.col("tier_name") == tier).withColumn("_asked", in_marks(marks) if marks else F.lit(True)).withColumn("mark", text_of())
    keys = list(scope) if scope or per_mark else ["tier_name"]
    bounds = duration_bounds(rows.where("_asked"), keys, lo, hi, range_mode, per_mark, min_count)
    judged = rows.join(bounds, [*keys, *(["mark"] if per_mark else [])], "left").withColumn("_enough", F.col("_asked") & F.col("n").isNotNull())
    fits = F.col("_enough") & (duration() >= F.col("lo")) & (duration() < F.col("hi"))
    judged = written(judged.select("grid_id", "t0", "t1", "_asked", "_enough", F.coalesce(fits, F.lit(False)).alias("_fits")))
    times = judged.where("_fits").select("grid_id", "t0", "t1").distinct()
    changed = intervals.where((F.col("tier_name") == assign_tier) & (text_of() != mark)).join(times, ["grid_id", "t0", "t1"], "left_semi")
    flags = {"considered": "_asked", "enough": "_enough", "matching": "_fits"}
    sums = judged.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(name) for name, c in flags.items()])
    counts = sums.select(F.explode(F.array(*[F.struct(F.lit(name).alias("counter"), F.col(name).alias("n")) for name in ("total", *flags)])).alias("x")).select("x.*")
    return counts.unionByName(changed.agg(F.lit("changed").alias("counter"), F.count(F.lit(1)).alias("n")))


def run_log(durations: DataFrame, column: str = "duration") -> DataFrame:
    d = F.col(column)
    return durations.agg(F.count(d).alias("n"), F.min(d).alias("shortest"), F.max(d).alias("longest"), F.avg(d).alias("mean"), F.sum(d).alias("total"))
