"""Pronunciation dictionaries: counting them from words and phonemes, and transcribing with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import COLUMNS, in_marks, is_empty, of_tiers, reindexed, text_of
from .splitting import share_time


def parts_within(intervals: DataFrame, word_tier: str, part_tier: str, ignore: list[str] = ("",)) -> DataFrame:
    """(grid_id, idx, word, parts): for each word, the marks of the other tier's intervals inside it, in order.

    Both tiers are put in one order of times, and a part belongs to the last word that starts at or before it: a
    running maximum along the grid instead of a range join, so the work is one sort.
    """
    words = intervals.where(F.col("tier_name") == word_tier).select("grid_id", "t0", "t1", "idx", text_of().alias("word"), F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("part"))
    parts = intervals.where((F.col("tier_name") == part_tier) & ~in_marks(list(ignore))).select("grid_id", "t0", "t1", "idx", F.lit(None).cast("string").alias("word"), F.lit(1).alias("_kind"), text_of().alias("part"))
    order = W.partitionBy("grid_id").orderBy("t0", "_kind", "idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = words.unionByName(parts).withColumn("_w", F.last(F.when(F.col("_kind") == 0, F.struct("idx", "word", "t1")), ignorenulls=True).over(order)).withColumn("_part_idx", F.col("idx"))
    inside = both.where((F.col("_kind") == 1) & (F.col("t1") <= F.col("_w.t1")))
    return inside.groupBy("grid_id", F.col("_w.idx").alias("idx"), F.col("_w.word").alias("word")).agg(F.transform(F.array_sort(F.collect_list(F.struct("t0", "_part_idx", "part"))), lambda x: x["part"]).alias("parts"))


def pronunciations(intervals: DataFrame, word_tier: str, part_tier: str, scope: list[str] = (), ignore: list[str] = ("",)) -> DataFrame:
    """(scope..., word, pronunciation, weight): how often a word has a sequence of parts. Words in ``ignore`` are left out."""
    found = parts_within(intervals, word_tier, part_tier, ignore).where(~in_marks(list(ignore), "word"))
    return found.groupBy(*scope, "word", F.col("parts").alias("pronunciation")).agg(F.count(F.lit(1)).alias("weight"))


def with_spaces(intervals: DataFrame, tiers: list[str]) -> DataFrame:
    """Marks with a space, which a dictionary cannot hold."""
    return intervals.where(of_tiers(intervals, tiers) & F.contains(text_of(), F.lit(" ")) & (F.btrim("mark") != ""))


def choose(dictionary: DataFrame, seed: int = 0) -> DataFrame:
    """(word, pronunciation): one for each word, drawn by weight.

    The draw is a hash of seed and word that falls into the running sum of weights, so equal words get the same pronunciation.
    """
    by = W.partitionBy("word").orderBy(F.desc("weight"), "pronunciation")
    run = dictionary.withColumn("_to", F.sum("weight").over(by)).withColumn("_all", F.sum("weight").over(W.partitionBy("word")))
    at = F.pmod(F.xxhash64(F.lit(seed), "word"), F.col("_all"))
    return run.where((F.col("_to") - F.col("weight") <= at) & (at < F.col("_to"))).select("word", "pronunciation")


def transcribe(intervals: DataFrame, dictionary: DataFrame, tiers: list[str], missing: str = "keep", replacement: str = "", seed: int = 0) -> DataFrame:
    """Replace each word by its pronunciation's parts, which share its time equally.

    Words that are not in the dictionary (word, pronunciation, weight): ``keep``, ``replace`` or ``error`` (the
    grid stays as it is). Times become doubles.
    """
    if missing not in ("keep", "replace", "error"):
        raise ValueError(f"no such mode: {missing}")
    double = intervals.withColumns({"t0": F.col("t0").cast("double"), "t1": F.col("t1").cast("double")})
    hit = of_tiers(intervals, tiers) & ~is_empty()
    rows = double.withColumn("_hit", hit).join(choose(dictionary, seed).withColumnRenamed("word", "mark"), "mark", "left")
    lost = F.col("_hit") & F.col("pronunciation").isNull()
    rows = rows.withColumn("_lost", F.max(lost.cast("int")).over(W.partitionBy("grid_id")) == 1 if missing == "error" else F.lit(False))
    absent = F.array(F.lit(replacement)) if missing == "replace" else F.array("mark")
    parts = F.when(~F.col("_hit") | F.col("_lost"), F.array("mark")).otherwise(F.coalesce("pronunciation", absent))
    parts = rows.withColumn("_parts", parts).withColumn("_n", F.size("_parts"))
    out = parts.select("*", F.posexplode("_parts").alias("_i", "_part")).drop("mark", "_parts")
    return reindexed(share_time(out, "_n", "_i").withColumnRenamed("_part", "mark"), "idx", "_i").select(*COLUMNS)
