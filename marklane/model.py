"""The interval model: one flat table of intervals for a whole corpus.

intervals: grid_id, tier_idx, tier_name, idx, t0, t1, mark
tiers:     grid_id, tier_idx, tier_name, kind, t0, t1, n_intervals
grids:     grid_id, t0, t1

A grid is one recording, a tier one ordered gap-free annotation of it. Tier
names may repeat, so (grid_id, tier_idx) is the key; idx orders a tier. Times
are doubles (seconds) from files, or exact long ticks. A null mark counts as an
empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["grid_id", "tier_idx"]
TIER = [*KEY, "tier_name"]
COLUMNS = [*TIER, "idx", "t0", "t1", "mark"]


def P():  # noqa: N802
    """The window of one tier in its order."""
    return W.partitionBy(*KEY).orderBy("idx")


# The code points that count as white space in a mark.
WHITESPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def duration() -> Column:
    return F.col("t1") - F.col("t0")


def text_of(mark: str = "mark") -> Column:
    return F.coalesce(F.col(mark), F.lit(""))


def is_pause(mark: str = "mark") -> Column:
    """Null, empty or white space only."""
    return F.btrim(text_of(mark), F.lit(WHITESPACE)) == ""


def is_empty(mark: str = "mark") -> Column:
    return text_of(mark) == ""


def in_marks(marks: list[str], mark: str = "mark") -> Column:
    """Membership in a set of marks; a null mark is in none."""
    return F.coalesce(F.col(mark).isin(sorted(set(marks))), F.lit(False)) if marks else F.lit(False)


def reindexed(df: DataFrame, *order: str) -> DataFrame:
    """Dense positions 0..n-1 in each tier by ``order``."""
    by = W.partitionBy(*KEY).orderBy(*(order or ("idx",)))
    return df.withColumn("idx", (F.row_number().over(by) - 1).cast("long")).select(*COLUMNS)


def of_tiers(intervals: DataFrame, names: list[str]) -> Column:
    return F.coalesce(F.col("tier_name").isin(sorted(set(names))), F.lit(False))


def on_tiers(intervals: DataFrame, names: list[str] | None, op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``op`` to the tiers of the given names (all if None); the others pass unchanged."""
    if names is None:
        return op(intervals)
    hit = of_tiers(intervals, names)
    return op(intervals.where(hit)).unionByName(intervals.where(~hit).select(*COLUMNS))


def stream_tiers(df: DataFrame, columns: list[str], step: Callable[[], Callable], out: T.StructField) -> DataFrame:
    """Append ``out``, computed by a fold along each tier.

    Rows are partitioned by tier and sorted; they stream through the fold, so a
    tier of any length needs constant memory. ``step()`` starts a tier; the function it returns
    takes the values of ``columns`` of the next row and gives the value of ``out``.
    """
    at = [df.columns.index(c) for c in columns]
    key = [df.columns.index(c) for c in KEY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, fold = None, None
        for batch in batches:
            values = []
            for k, *row in zip(zip(*(batch.column(i).to_pylist() for i in key), strict=True), *(batch.column(i).to_pylist() for i in at), strict=True):
                if fold is None or k != current:
                    current, fold = k, step()
                values.append(fold(*row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, to_arrow(out.dataType))], names=[*batch.schema.names, out.name])

    schema = T.StructType([*df.schema.fields, out])
    return df.repartition(*KEY).sortWithinPartitions(*KEY, "idx").mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_files"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` from files in the shared folder, where several parts of a plan need it: it is computed once, and lost executors take nothing along."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
