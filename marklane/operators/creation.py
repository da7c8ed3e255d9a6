"""Grids from texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import COLUMNS, reindexed, text_of


def create_grids(texts: DataFrame, tier_name: str = "text", chars_per_second: float = 15.0) -> DataFrame:
    """One tier per text: (grid_id, text[, n_samples, sample_rate][, start, end]).

    The length comes from the audio where there is one, else from the number of
    characters. With a start or end, empty intervals pad the text's own. Rows
    that cannot be a grid give none here and an error in ``creation_errors``.
    """
    rows = _prepared(texts, chars_per_second).where(F.col("error").isNull())
    parts = F.array(
        F.struct(F.lit(0.0).alias("t0"), F.col("_start").alias("t1"), F.lit("").alias("mark")),
        F.struct(F.col("_start").alias("t0"), F.col("_end").alias("t1"), F.col("text").alias("mark")),
        F.struct(F.col("_end").alias("t0"), F.col("_size").alias("t1"), F.lit("").alias("mark")),
    )
    out = rows.select("grid_id", F.posexplode(F.filter(parts, lambda x: x["t0"] < x["t1"])).alias("idx", "x"))
    return reindexed(out.select("grid_id", F.lit(0).alias("tier_idx"), F.lit(tier_name).alias("tier_name"), F.col("idx").cast("long").alias("idx"), "x.t0", "x.t1", "x.mark")).select(*COLUMNS)


def creation_errors(texts: DataFrame, chars_per_second: float = 15.0) -> DataFrame:
    """(grid_id, error) of texts that cannot be a grid."""
    return _prepared(texts, chars_per_second).where(F.col("error").isNotNull()).select("grid_id", "error")


def _prepared(texts: DataFrame, chars_per_second: float) -> DataFrame:
    if chars_per_second <= 0:
        raise ValueError("characters per second must be positive")
    have = set(texts.columns)
    column = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    size = F.coalesce(column("n_samples", "long") / column("sample_rate", "double"), F.length(text_of("text")) / F.lit(float(chars_per_second)))
    start, end = column("start", "double"), column("end", "double")
    error = (
        F.when(text_of("text") == "", "text is empty")
        .when(start < 0, "start is negative")
        .when(start >= size, "start is not before the end of the audio")
        .when(end <= F.coalesce(start, F.lit(0.0)), "end is not behind the start")
        .when(end >= size, "end is not before the end of the audio")
        .when(~(size > 0), "length is not positive")
    )
    return texts.select("grid_id", text_of("text").alias("text"), size.alias("_size"), F.coalesce(start, F.lit(0.0)).alias("_start"), F.coalesce(end, size).alias("_end"), error.alias("error"))
