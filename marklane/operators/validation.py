"""Which grids an operator can take, and why not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import KEY, P, in_marks, of_tiers, text_of
from .rounding import samples


def invalid_grids(intervals: DataFrame) -> DataFrame:
    """(grid_id, error): grids with negative or empty spans, gaps, overlaps, or tiers of different spans."""
    rows = intervals.withColumn("_before", F.lag("t1").over(P()))
    per_tier = rows.groupBy(*KEY).agg(
        F.min_by("t0", "idx").alias("lo"), F.max_by("t1", "idx").alias("hi"),
        F.max((F.col("t0") >= F.col("t1")).cast("int")).alias("empty"), F.max((F.col("_before") != F.col("t0")).cast("int")).alias("gap"), F.max((F.col("t0") < 0).cast("int")).alias("negative"),
    )
    per_grid = per_tier.groupBy("grid_id").agg(F.countDistinct("lo", "hi").alias("spans"), *[F.max(c).alias(c) for c in ("empty", "gap", "negative")])
    error = F.when(F.col("negative") == 1, "a time is negative").when(F.col("empty") == 1, "an interval does not last").when(F.col("gap") == 1, "intervals are not consecutive").when(F.col("spans") > 1, "tiers have different spans")
    return per_grid.select("grid_id", error.alias("error")).where(F.col("error").isNotNull())


def missing_boundaries(intervals: DataFrame, boundary_tier: str, tiers: list[str]) -> DataFrame:
    """(grid_id, tier_idx, t): boundaries of a tier that target tiers lack."""
    bounds = intervals.where(F.col("tier_name") == boundary_tier).select("grid_id", F.explode(F.array("t0", "t1")).alias("t")).distinct()
    target = intervals.where(of_tiers(intervals, tiers))
    have = target.select(*KEY, F.explode(F.array("t0", "t1")).alias("t")).distinct()
    return target.select(*KEY).distinct().join(bounds, "grid_id").join(have, [*KEY, "t"], "left_anti")


def tier_errors(tiers: DataFrame, exist: list[str] = (), unique: list[str] = (), absent: list[str] = ()) -> DataFrame:
    """(grid_id, error): required tiers that are missing or repeated, and names that are taken. ``tiers``: grid_id, tier_idx, tier_name."""
    count = lambda name: F.size(F.collect_set(F.when(F.col("tier_name") == name, F.col("tier_idx"))))
    checks = [(count(n) == 0, f"tier does not exist: {n}") for n in [*exist, *unique]]
    checks += [(count(n) > 1, f"several tiers have the name: {n}") for n in unique] + [(count(n) > 0, f"tier exists already: {n}") for n in absent]
    per = tiers.groupBy("grid_id").agg(F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks])).alias("errors")) if checks else tiers.select("grid_id", F.array().cast("array<string>").alias("errors")).distinct()
    return per.where(F.size("errors") > 0).select("grid_id", F.col("errors")[0].alias("error"))


def audio_mismatches(intervals: DataFrame, audio: DataFrame) -> DataFrame:
    """(grid_id, n_samples, expected): grids whose end is not the end of their audio.

    Seconds become samples by rounding to four digits before rounding up, on the exact binary value.
    """
    ends = intervals.groupBy("grid_id").agg(F.max("t1").cast("double").alias("t1"))
    return ends.join(audio, "grid_id").withColumn("expected", samples(F.col("t1"), F.col("sample_rate"))).where(F.col("expected") != F.col("n_samples")).select("grid_id", "n_samples", "expected")


def unequal_counts(intervals: DataFrame, source: str, target: str) -> DataFrame:
    """(grid_id, n_source, n_target): grids in which two tiers differ in their number of intervals."""
    n = lambda name: F.sum((F.col("tier_name") == name).cast("long"))
    return intervals.groupBy("grid_id").agg(n(source).alias("n_source"), n(target).alias("n_target")).where("n_source <> n_target")


def missing_words(intervals: DataFrame, dictionary: DataFrame, tiers: list[str]) -> DataFrame:
    """(word, n): words of the tiers that the dictionary lacks."""
    words = intervals.where(of_tiers(intervals, tiers) & ~in_marks([""]) & F.col("mark").isNotNull()).groupBy(F.col("mark").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return words.join(dictionary.select("word").distinct(), "word", "left_anti")


def results(before: DataFrame, after: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(grid_id, error, changed): one row per grid of ``before``. A grid with an error counts as unchanged."""
    cols = ["tier_idx", "tier_name", "idx", "t0", "t1"]
    digest = lambda d, name: d.groupBy("grid_id").agg(F.count(F.lit(1)).alias(f"{name}_n"), F.sum(F.xxhash64(*cols, text_of()).cast("decimal(38,0)")).alias(name))
    joined = digest(before, "x").join(digest(after, "y"), "grid_id", "left")
    joined = joined.join(errors.groupBy("grid_id").agg(F.min("error").alias("error")), "grid_id", "left") if errors is not None else joined.withColumn("error", F.lit(None).cast("string"))
    same = F.col("x").eqNullSafe(F.col("y")) & F.col("x_n").eqNullSafe(F.col("y_n"))
    return joined.select("grid_id", "error", (F.col("error").isNull() & ~same).alias("changed"))
