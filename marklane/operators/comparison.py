"""Comparing two annotations of the same material."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import duration, in_marks, text_of, written
from .orderstats import at_ranks


def paired(a: DataFrame, b: DataFrame, tier: str, ignore: list[str] = ()) -> DataFrame:
    """(grid_id, k, mark_a, mark_b, da, db): the intervals of a tier in both annotations by position; nulls where one has no partner."""
    by = W.partitionBy("grid_id").orderBy("tier_idx", "idx")
    number = lambda d, m, n: d.where((F.col("tier_name") == tier) & ~in_marks(list(ignore))).select("grid_id", (F.row_number().over(by) - 1).cast("long").alias("k"), text_of().alias(m), duration().alias(n))
    return number(a, "mark_a", "da").join(number(b, "mark_b", "db"), ["grid_id", "k"], "full_outer")


def mismatches(pairs: DataFrame) -> DataFrame:
    """(grid_id, n): grids in which numbers or marks differ."""
    return pairs.where(~F.col("mark_a").eqNullSafe(F.col("mark_b"))).groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"))


def bins_of(limits: list[float], ignore_zero: bool) -> list[tuple[str, float, float]]:
    """(name, above, up to) of each bin; infinity closes the last."""
    edges = sorted(set(limits) - {0, float("inf")})
    if not edges:
        return []
    out, low = [], -1.0 if ignore_zero else 0.0
    for hi in [*edges, float("inf")]:
        out.append((f"Match({low:g},{hi:g}]ms", low, hi))
        low = hi
    return out


def boundary_stats(pairs: DataFrame, groups: dict[str, list[str]] | None = None, limits: list[float] = (), ignore_zero: bool = False, to_ms: float = 1000.0) -> DataFrame:
    """One row per mark, per group of marks and for all (``-ALL-``): durations in both annotations and their absolute differences in whole ms.

    Grids with mismatches must be left out before. ``to_ms`` turns a duration into ms. Groups without a mark that occurs give no row.
    A mark that a group names twice counts once. The pairs are computed once; medians are exact order statistics (``orderstats``), so no group is brought together.
    """
    rows = written(pairs.select(F.col("mark_a").alias("mark"), (F.col("da") * to_ms).alias("a"), (F.col("db") * to_ms).alias("b"), F.abs(F.bround((F.col("da") - F.col("db")) * to_ms, 0)).alias("diff")))
    entry = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("kind"))
    own = F.array(entry(F.col("mark"), "mark"), entry(F.lit("-ALL-"), "group"))
    names = [(g, m) for g, marks in (groups or {}).items() for m in dict.fromkeys(marks)]
    if names:
        table = rows.sparkSession.createDataFrame(names, "name string, mark string").groupBy("mark").agg(F.collect_list(entry(F.col("name"), "group")).alias("_groups"))
        rows = rows.join(table, "mark", "left")
        own = F.concat(own, F.coalesce("_groups", F.array().cast(table.schema["_groups"].dataType)))
    named = rows.select(F.explode(own).alias("_of"), "a", "b", "diff").select("_of.*", "a", "b", "diff")
    d = F.col("diff")
    stats = [F.count(F.lit(1)).alias("n")]
    for c in ("a", "b"):
        stats += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"sd_{c}")]
    stats += [F.min(d).alias("min_diff"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"), F.stddev_pop(d).alias("sd_diff"), F.sum(d).alias("sum_diff")]
    bins = bins_of(list(limits), ignore_zero)
    if bins and not ignore_zero:
        bins = [("Match0ms", -1.0, 0.0), *bins]
    for name, lo, hi in bins:
        hit = (d > lo) & (d <= hi)
        stats += [F.sum(hit.cast("long")).alias(name), (F.sum(hit.cast("long")) * 100.0 / F.count(F.lit(1))).alias(f"{name}%")]
    middle = at_ranks(named, ["name", "kind"], "diff", [lambda n: F.floor((n - 1) / 2), lambda n: F.ceil((n - 1) / 2)])
    medians = middle.select(F.col("name").alias("_name"), F.col("kind").alias("_kind"), ((F.col("stats")[0] + F.col("stats")[1]) / 2).alias("median_diff"))
    found = named.groupBy("name", "kind").agg(*stats)
    return found.join(medians, F.col("name").eqNullSafe(F.col("_name")) & (F.col("kind") == F.col("_kind")), "left").drop("_name", "_kind")


def equal_tiers(a: DataFrame, b: DataFrame) -> DataFrame:
    """(grid_id, tier_idx, equal): tiers with the same name, times and marks in both."""
    key = ["grid_id", "tier_idx", "idx"]
    joined = a.select(*key, F.struct("tier_name", "t0", "t1", text_of()).alias("x")).join(b.select(*key, F.struct("tier_name", "t0", "t1", text_of()).alias("y")), key, "full_outer")
    return joined.groupBy("grid_id", "tier_idx").agg(F.min(F.col("x").eqNullSafe(F.col("y"))).alias("equal"))
