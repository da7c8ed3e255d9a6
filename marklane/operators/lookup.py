"""As-of lookups: for every row of one table, the row of another one that is nearest in time, before or after.

Both sides are put in one order of times and a running value finds the answer: one sort, no join of all rows with all
rows. A key whose rows are too many for one task is cut into time blocks of equal width; each block runs by itself, and the value
with which it begins is carried over from the ends of the blocks before it, a table with one row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(rows: DataFrame, points: DataFrame, by: list[str], at: Column, t: str = "t", out: str = "_at", after: bool = False, strict: bool = False, width: float | None = None, ties: list[str] = ()) -> DataFrame:
    """Append ``out``: the struct of the columns of the last of ``points`` with the same ``by`` and ``t`` <= ``at``; null if there is none.

    ``after``: the first with ``t`` >= ``at``. ``strict``: equal times do not count. Of points with equal times the last (``after``: the first) by
    ``ties`` is taken; points with a null time are in no row's reach, rows with a null time find nothing. All rows stay, repeated ones too.
    With ``width`` no task holds more of a key than a time block of that width.
    """
    of = [c for c in points.columns if c not in by]
    kind = points.select(F.struct(*of)).schema[0].dataType
    mine = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    left = rows.select(*by, at.alias("_t"), F.lit(1).alias("_kind"), mine.alias("_row"), F.lit(None).cast(kind).alias("_p"))
    shape = left.schema["_row"].dataType
    right = points.where(F.col(t).isNotNull()).select(*by, F.col(t).cast(left.schema["_t"].dataType).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(shape).alias("_row"), F.struct(*of).alias("_p"))
    tied = [F.col("_p")[c] for c in ties]
    if after:
        order = [F.desc_nulls_last("_t"), F.desc("_kind") if strict else F.asc("_kind"), *[c.desc() for c in tied]]
    else:
        order = [F.asc_nulls_first("_t"), F.desc("_kind") if strict else F.asc("_kind"), *tied]
    both = right.unionByName(left)
    block = F.lit(0) if width is None else F.coalesce(F.floor(F.col("_t") / width), F.lit(0)).cast("long")
    keys = [*by, "_block"] if width is not None else [*by]
    both = both.withColumn("_block", block)
    running = F.last("_p", ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    found = both.withColumn("_p", running)
    if width is not None:
        along = W.partitionBy(*by).orderBy(F.desc("_block") if after else F.asc("_block")).rowsBetween(W.unboundedPreceding, -1)
        best = (F.min_by if after else F.max_by)("_p", F.struct("_t", *[F.col("_p")[c].alias(f"_tie{i}") for i, c in enumerate(ties)]))
        ends = both.where("_kind = 0").groupBy(*keys).agg(best.alias("_end"))
        blocks = both.where("_kind = 1").select(*keys).distinct().join(ends, keys, "full")
        carried = blocks.withColumn("_carry", F.last("_end", ignorenulls=True).over(along)).drop("_end")
        found = found.where("_kind = 1").join(carried.where("_carry is not null"), keys, "left").withColumn("_p", F.coalesce("_p", "_carry"))
    found = found.where("_kind = 1").withColumn("_p", F.when(F.col("_t").isNotNull(), F.col("_p")))
    return found.select(*[F.col("_row").getField(c).alias(c) for c in rows.columns], F.col("_p").alias(out))


def numbered(rows: DataFrame, by: list[str], t: str, out: str, width: float | None = None) -> DataFrame:
    """Append ``out``, the place of each row of a key in order of time, from 0. With ``width`` rows are counted in time blocks, and the sums of the blocks before are added."""
    if width is None:
        return rows.withColumn(out, (F.row_number().over(W.partitionBy(*by).orderBy(t)) - 1).cast("long"))
    blocked = rows.withColumn("_block", F.coalesce(F.floor(F.col(t) / width), F.lit(0)).cast("long"))
    counts = blocked.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*by, "_block", (F.sum("_n").over(W.partitionBy(*by).orderBy("_block")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*by, "_block").orderBy(t)) - 1
    return blocked.withColumn("_inside", inside).join(before, [*by, "_block"]).withColumn(out, (F.col("_before") + F.col("_inside")).cast("long")).drop("_block", "_inside", "_before")


def enclosing(points: DataFrame, intervals: DataFrame, t: str = "t", out: str = "_in", width: float | None = None) -> DataFrame:
    """Append ``out``: the interval (idx, t0, t1, mark) of the tier that holds each timepoint (grid_id, tier_idx, t), and whether it had to be clamped.

    An interval holds its start, not its end. Timepoints before the first interval take the first, those behind the last the last
    (``clamped``). Tiers without intervals give null.
    """
    key = ["grid_id", "tier_idx"]
    spans = intervals.select(*key, "idx", "t0", "t1", "mark")
    first = spans.groupBy(*key).agg(F.min_by(F.struct("idx", "t0", "t1", "mark"), "idx").alias("_first"))
    found = asof(points, spans, key, F.col(t), "t0", "_held", width=width, ties=["idx"]).join(first, key, "left")
    span = F.coalesce("_held", "_first")
    clamped = F.col("_held").isNull() | (F.col(t) >= F.col("_held.t1"))
    inside = F.when(span.isNotNull(), F.struct(span["idx"].alias("idx"), span["t0"].alias("t0"), span["t1"].alias("t1"), span["mark"].alias("mark"), clamped.alias("clamped")))
    return found.withColumn(out, inside).select(*points.columns, out)
