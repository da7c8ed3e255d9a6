"""Interval tables over the driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import COLUMNS


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid per user, an interval from each event to the next; 'error' counts as a pause. Times are exact microseconds."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = rows.withColumn("t0", t).withColumn("t1", F.lead("t0").over(by)).withColumn("idx", (F.row_number().over(by) - 1).cast("long"))
    mark = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    return rows.where("t1 is not null").select(F.col("user_id").alias("grid_id"), F.lit(0).alias("tier_idx"), F.lit("events").alias("tier_name"), "idx", "t0", "t1", mark.alias("mark"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid per conversation with two tiers of unit intervals: texts and roles."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    tiers = F.array(F.struct(F.lit(0).alias("i"), F.lit("text").alias("n"), F.col("text").alias("m")), F.struct(F.lit(1).alias("i"), F.lit("role").alias("n"), F.col("role").alias("m")))
    out = rows.select("conv_id", "turn", F.explode(tiers).alias("x"))
    return out.select(F.col("conv_id").alias("grid_id"), F.col("x.i").alias("tier_idx"), F.col("x.n").alias("tier_name"), F.col("turn").alias("idx"), F.col("turn").alias("t0"), (F.col("turn") + 1).alias("t1"), F.col("x.m").alias("mark"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid and one interval per document, from 0 to its number of characters."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select(F.col("doc_id").alias("grid_id"), F.lit(0).alias("tier_idx"), F.lit("text").alias("tier_name"), F.lit(0).cast("long").alias("idx"), F.lit(0).cast("long").alias("t0"), F.col("n_chars").alias("t1"), F.col("text").alias("mark"))


def with_phases(iv: DataFrame) -> DataFrame:
    """The events tier and a second tier whose boundaries are the starts of 'signup' events and the edges."""
    from ..operators.joining import chunks_by, merge_chunks
    from ..model import P, written

    iv = written(iv)  # used twice: else all that makes it, and the sorts of both uses, stand in one task side by side
    start = (F.col("mark") == "signup") | (F.row_number().over(P()) == 1)
    phases = merge_chunks(chunks_by(start, iv)).select("grid_id", F.lit(1).alias("tier_idx"), F.lit("phases").alias("tier_name"), "idx", "t0", "t1", F.lit("phase").alias("mark"))
    return iv.select(*COLUMNS).unionByName(phases)


def jittered(iv: DataFrame, most: int = 2_000_000) -> DataFrame:
    """The same annotation with inner boundaries moved by a little, fixed for each place."""
    from ..model import P

    size = F.least(F.lit(most), F.floor((F.col("t1") - F.col("t0")) / 4).cast("long"), F.floor((F.lead("t1").over(P()) - F.col("t1")) / 4).cast("long"))
    step = (F.col("grid_id") * 31 + F.col("idx") * 17) % 7 - 3
    move = F.when(F.lead("t1").over(P()).isNull(), 0).otherwise(F.floor(size * step / 3.0).cast("long"))
    moved = iv.withColumn("_t1", F.col("t1") + move)
    return moved.withColumn("_t0", F.coalesce(F.lag("_t1").over(P()), F.col("t0"))).drop("t0", "t1").withColumnsRenamed({"_t0": "t0", "_t1": "t1"}).select(*COLUMNS)


SQL_EVENTS = """
ev AS (
  SELECT user_id AS grid_id, row_number() OVER w - 1 AS idx, epoch_us(ts) AS t0, lead(epoch_us(ts)) OVER w AS t1,
    CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS mark
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), iv AS (SELECT * FROM ev WHERE t1 IS NOT NULL)"""

SQL_PHASES = """
ph AS (
  SELECT grid_id, chunk - 1 AS idx, min(t0) AS t0, max(t1) AS t1 FROM (
    SELECT *, sum(CASE WHEN mark = 'signup' OR idx = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY grid_id ORDER BY idx) AS chunk FROM iv
  ) GROUP BY grid_id, chunk
)"""

SQL_JITTER = """
jw AS (
  SELECT *, lead(t1) OVER (PARTITION BY grid_id ORDER BY idx) AS nt FROM iv
), jm AS (
  SELECT *, t1 + CASE WHEN nt IS NULL THEN 0 ELSE CAST(floor(least(2000000, CAST(floor((t1 - t0) / 4) AS BIGINT), CAST(floor((nt - t1) / 4) AS BIGINT)) * ((grid_id * 31 + idx * 17) % 7 - 3) / 3.0::DOUBLE) AS BIGINT) END AS u1 FROM jw
), ji AS (
  SELECT grid_id, idx, mark, coalesce(lag(u1) OVER (PARTITION BY grid_id ORDER BY idx), t0) AS t0, u1 AS t1 FROM jm
)"""
