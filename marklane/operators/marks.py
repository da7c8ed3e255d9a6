"""Rewriting marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import COLUMNS, KEY, duration, in_marks, is_empty, of_tiers, text_of
from .regex import found, substituted
from .selection import positional


def map_marks(intervals: DataFrame, mapping: dict[str, str], ignore: list[str] | None = None, unmapped: str | None = None, replace_unmapped: bool = False, tiers: list[str] | None = None) -> DataFrame:
    """Look whole marks up in a mapping; marks in ``ignore`` stay ('' by default).

    With ``replace_unmapped`` all other marks become ``unmapped`` (None: empty). Spark knows the mapping's size and broadcasts it
    if it is small.
    """
    ignore = [""] if ignore is None else ignore
    rows = intervals.sparkSession.createDataFrame(list(mapping.items()) or [("", "")], "_from string, _to string").limit(len(mapping))
    joined = intervals.join(rows, F.col("mark") == F.col("_from"), "left")
    other = F.lit(unmapped or "") if replace_unmapped else F.col("mark")
    new = F.when(in_marks(ignore), F.col("mark")).when(F.col("_from").isNotNull(), F.col("_to")).otherwise(other)
    new = new if tiers is None else F.when(of_tiers(intervals, tiers), new).otherwise(F.col("mark"))
    return joined.withColumn("mark", new).select(*COLUMNS)


def replace_text(intervals: DataFrame, pattern: str, replacement: str, mode: str = "all", tiers: list[str] | None = None) -> DataFrame:
    """Substitute a regular expression (Python's dialect, see ``regex``) in marks in which it is found; ``mode`` as in ``selection.matching``."""
    rows = positional(intervals.withColumn("_found", found(pattern)(text_of())), F.col("_found"), mode)
    hit = F.col("_chosen") if tiers is None else F.col("_chosen") & of_tiers(intervals, tiers)
    return rows.withColumn("mark", F.when(hit, substituted(pattern, replacement)(text_of())).otherwise(F.col("mark"))).select(*COLUMNS)


def map_tier(intervals: DataFrame, source: str, target: str, mode: str = "replace", consider: list[str] | None = None) -> DataFrame:
    """Carry marks from one tier to another by position, to replace, prepend or append.

    With ``consider`` only intervals with these marks of either tier count. Grids in which the numbers differ stay as they are.
    """
    if mode not in ("replace", "prepend", "append"):
        raise ValueError(f"no such mode: {mode}")
    keep = in_marks(consider) if consider else F.lit(True)
    order = W.partitionBy("grid_id").orderBy("tier_idx", "idx")
    number = lambda name: intervals.where((F.col("tier_name") == name) & keep).withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("grid_id")))
    a = number(source).select("grid_id", "_k", "_n", text_of().alias("_from"))
    b = number(target).select("grid_id", "_k", "_n", "tier_idx", "idx")
    pairs = b.join(a, ["grid_id", "_k", "_n"]).select("grid_id", "tier_idx", "idx", "_from")
    rows = intervals.join(pairs, [*KEY, "idx"], "left")
    new = {"replace": F.col("_from"), "prepend": F.concat("_from", text_of()), "append": F.concat(text_of(), "_from")}[mode]
    return rows.withColumn("mark", F.when(F.col("_from").isNotNull(), new).otherwise(F.col("mark"))).select(*COLUMNS)


def remove_symbols(intervals: DataFrame, symbols: list[str] = (), only: list[str] = (), whole: list[str] = (), tiers: list[str] | None = None) -> DataFrame:
    """Empty marks in ``whole``; empty marks made of ``only`` texts alone; remove ``symbols`` inside marks. Texts are taken in sorted order."""
    if not symbols and not only and not whole:
        raise ValueError("nothing is given to remove")

    def without(c: Column, texts) -> Column:
        for s in sorted(texts):
            c = F.replace(c, F.lit(s), F.lit(""))
        return c

    new = F.when(in_marks(list(whole)), F.lit("")).when(F.lit(bool(only)) & (without(text_of(), only) == ""), F.lit("")).otherwise(without(text_of(), symbols))
    new = new if tiers is None else F.when(of_tiers(intervals, tiers), new).otherwise(F.col("mark"))
    return intervals.withColumn("mark", new).select(*COLUMNS)


def mark_silence(intervals: DataFrame, mark: str, shortest: float, longest: float, tiers: list[str] | None = None) -> DataFrame:
    """Give silent intervals (empty or null marks) of a duration in [shortest, longest) a mark."""
    if not shortest < longest:
        raise ValueError("the longest duration must be above the shortest")
    hit = is_empty() & (duration() >= shortest) & (duration() < longest)
    hit = hit if tiers is None else hit & of_tiers(intervals, tiers)
    return intervals.withColumn("mark", F.when(hit, F.lit(mark)).otherwise(F.col("mark"))).select(*COLUMNS)


def assign_from(intervals: DataFrame, source: str, target: str, chosen: DataFrame, mark: str) -> DataFrame:
    """Mark the intervals of ``target`` that have the same times as ``chosen`` ones (grid_id, t0, t1) of ``source``."""
    keys = chosen.select("grid_id", "t0", "t1").distinct().withColumn("_hit", F.lit(True))
    rows = intervals.join(keys, ["grid_id", "t0", "t1"], "left")
    hit = F.col("_hit") & (F.col("tier_name") == target)
    return rows.withColumn("mark", F.when(F.coalesce(hit, F.lit(False)), F.lit(mark)).otherwise(F.col("mark"))).select(*COLUMNS)
