"""Splitting intervals and grids, and tiers from and to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import COLUMNS, KEY, is_empty, is_pause, on_tiers, reindexed, text_of
from .selection import last_span


def parts_of(text: Column, symbol: str, keep: bool = False) -> Column:
    """The parts of a text at each literal ``symbol`` (every code point for ''); with ``keep`` the symbol stands between them."""
    parts = F.split(text, "" if symbol == "" else "\\Q" + symbol.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    if not keep:
        return parts
    return F.flatten(F.transform(parts, lambda x, i: F.when(i == 0, F.array(x)).otherwise(F.array(F.lit(symbol), x))))


def share_time(rows: DataFrame, n: str, i: str) -> DataFrame:
    """Give part ``i`` of ``n`` its equal share of [t0, t1]; the outer edges stay exact."""
    span, t0, t1 = F.col("t1") - F.col("t0"), F.col("t0"), F.col("t1")
    cut = lambda k: t0 + (k.cast("double") / F.col(n)) * span
    return rows.withColumns({
        "_a": F.when(F.col(i) == 0, t0.cast("double")).otherwise(cut(F.col(i))),
        "_b": F.when(F.col(i) + 1 == F.col(n), t1.cast("double")).otherwise(cut(F.col(i) + 1)),
    }).drop("t0", "t1").withColumnsRenamed({"_a": "t0", "_b": "t1"})


def split_intervals(intervals: DataFrame, symbol: str = " ", keep: bool = False, tiers: list[str] | None = None) -> DataFrame:
    """Split marks at a symbol; parts get equal shares of their interval. Empty parts stay; null and empty marks are not split. Times become doubles."""

    def op(d: DataFrame) -> DataFrame:
        parts = F.when(is_empty(), F.array("mark")).otherwise(parts_of(text_of(), symbol, keep))
        rows = d.withColumn("_parts", parts).withColumn("_n", F.size("_parts"))
        rows = rows.select("*", F.posexplode("_parts").alias("_i", "_part")).drop("mark", "_parts")
        return reindexed(share_time(rows, "_n", "_i").withColumnRenamed("_part", "mark"), "idx", "_i")

    as_double = intervals.withColumns({"t0": F.col("t0").cast("double"), "t1": F.col("t1").cast("double")})
    return on_tiers(as_double, tiers, op)


def text_to_tier(grids: DataFrame, texts: DataFrame, tier_name: str, tier_idx: int, sep: str = "\n") -> DataFrame:
    """A new tier from texts (grid_id, text): the parts at ``sep`` spread evenly over the span of each grid (grid_id, t0, t1)."""
    rows = grids.join(texts, "grid_id").select("grid_id", F.lit(tier_idx).alias("tier_idx"), F.lit(tier_name).alias("tier_name"), F.lit(0).cast("long").alias("idx"), F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"), text_of("text").alias("mark"))
    rows = rows.withColumn("_parts", parts_of(F.col("mark"), sep)).withColumn("_n", F.size("_parts"))
    rows = rows.select("*", F.posexplode("_parts").alias("_i", "_part")).drop("mark", "_parts")
    return reindexed(share_time(rows, "_n", "_i").withColumnRenamed("_part", "mark"), "_i")


def tier_to_text(intervals: DataFrame, sep: str = "\n") -> DataFrame:
    """(grid_id, tier_idx, text): the marks of each tier in order."""
    marks = F.transform(F.array_sort(F.collect_list(F.struct("idx", text_of().alias("m")))), lambda x: x["m"])
    return intervals.groupBy(*KEY).agg(F.array_join(marks, sep).alias("text"))


def split_grids(intervals: DataFrame, tier: str, include_empty: bool = False) -> DataFrame:
    """Every interval of a tier becomes a grid of its own with what all tiers hold in it, times from 0.

    New ids are ``grid/NNN``, padded to the width of the grid's number of intervals. All tiers must have the
    tier's boundaries: grids that do not are named by ``validation.missing_boundaries`` and give no rows.
    """
    by = W.partitionBy("grid_id")
    spans = intervals.where(F.col("tier_name") == tier).select("grid_id", "idx", F.col("t0").alias("lo"), F.col("t1").alias("hi"), (F.lit(not include_empty) & is_pause()).alias("left_out"))
    counted = spans.withColumns({
        "n": F.count(F.lit(1)).over(by), "end": F.max("hi").over(by), "named": F.sum((~F.col("left_out")).cast("int")).over(by), "k": F.row_number().over(by.orderBy("left_out", "idx")) - 1,
    })
    # a tier of a valid grid has all boundaries if an interval starts at each span's start and the last one ends where the spans end
    tagged = last_span(intervals, counted)
    of_tier = W.partitionBy("grid_id", "tier_idx")
    starts = F.sum((F.col("t0") == F.col("_span.lo")).cast("int")).over(of_tier)
    fits = tagged.withColumn("_fits", F.coalesce((starts == F.col("_span.n")) & (F.max("t1").over(of_tier) == F.col("_span.end")), F.lit(False)))
    whole = fits.withColumn("_ok", F.min(F.col("_fits").cast("int")).over(by) == 1).where("_ok and not _span.left_out")
    new_id = F.concat_ws("/", F.col("grid_id").cast("string"), F.lpad(F.col("_span.k").cast("string"), F.length(F.col("_span.named").cast("string")), F.lit("0")))
    lo = F.col("_span.lo")
    shifted = whole.select(new_id.alias("grid_id"), "tier_idx", "tier_name", "idx", (F.col("t0") - lo).alias("t0"), (F.col("t1") - lo).alias("t1"), "mark")
    return reindexed(shifted).select(*COLUMNS)
