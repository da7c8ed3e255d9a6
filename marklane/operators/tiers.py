"""Renaming, copying, moving and adding tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import COLUMNS

def _grid():
    return W.partitionBy("grid_id")



def _count(name: str):
    return F.size(F.collect_set(F.when(F.col("tier_name") == name, F.col("tier_idx"))).over(_grid()))


def rename_tier(intervals: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a tier. Grids stay as they are where ``old`` is not unique or ``new`` exists."""
    ok = (_count(old) == 1) & (_count(new) == 0)
    return intervals.withColumn("_ok", ok).withColumn("tier_name", F.when(F.col("_ok") & (F.col("tier_name") == old), F.lit(new)).otherwise(F.col("tier_name"))).select(*COLUMNS)


def clone_tier(intervals: DataFrame, name: str, copies: list[str], ignore_marks: bool = False) -> DataFrame:
    """Append copies of a unique tier under new names, in order, with empty marks if ``ignore_marks``."""
    top = intervals.withColumn("_top", F.max("tier_idx").over(_grid())).withColumn("_n", _count(name))
    source = top.where((F.col("tier_name") == name) & (F.col("_n") == 1))
    names = F.posexplode(F.array(*map(F.lit, copies)))
    new = source.select("*", names.alias("_i", "_name")).select(
        "grid_id", (F.col("_top") + 1 + F.col("_i")).cast(intervals.schema["tier_idx"].dataType).alias("tier_idx"), F.col("_name").alias("tier_name"), "idx", "t0", "t1", (F.lit("") if ignore_marks else F.col("mark")).alias("mark")
    )
    return intervals.select(*COLUMNS).unionByName(new)


def move_tier(intervals: DataFrame, name: str, position: int) -> DataFrame:
    """Move a unique tier to a position from 1 to the number of tiers; out of range, a grid stays as it is."""
    rank = F.dense_rank().over(_grid().orderBy("tier_idx"))
    rows = intervals.withColumn("_r", rank).withColumn("_n", F.max("_r").over(_grid())).withColumn("_c", _count(name))
    rows = rows.withColumn("_from", F.max(F.when(F.col("tier_name") == name, F.col("_r"))).over(_grid()))
    ok = (F.col("_c") == 1) & (F.lit(position) >= 1) & (F.lit(position) <= F.col("_n"))
    r, to = F.col("_r"), F.lit(position)
    moved = F.when(r == F.col("_from"), to).when((r > F.col("_from")) & (r <= to), r - 1).when((r < F.col("_from")) & (r >= to), r + 1).otherwise(r)
    kind = intervals.schema["tier_idx"].dataType
    return rows.withColumn("tier_idx", F.when(F.coalesce(ok, F.lit(False)), (moved - 1).cast(kind)).otherwise(F.col("tier_idx"))).select(*COLUMNS)


def append_tier(intervals: DataFrame, tier: DataFrame) -> DataFrame:
    """Append one tier per grid behind the others."""
    top = intervals.groupBy("grid_id").agg((F.max("tier_idx") + 1).alias("_top"))
    new = tier.join(top, "grid_id", "left").withColumn("tier_idx", F.coalesce("_top", F.lit(0)).cast(intervals.schema["tier_idx"].dataType))
    return intervals.select(*COLUMNS).unionByName(new.select(*COLUMNS))
