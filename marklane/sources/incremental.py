"""Incremental runs: files that arrive in a folder are taken up once, in batches, and their results written next to a log.

The folder is a file stream; its offsets and commits are the log, in the checkpoint folder of the run. A batch writes the files of
its grids, each whole or not at all, and then its outcomes into a folder named by its number, which replaces what an
earlier attempt of the same batch left. The commit that follows closes the batch. A run that breaks off in between leaves a batch without
commit: the next run takes up the same files under the same number and writes the same results over them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import gridfile

OUTCOMES = "batch long, grid_id string, outcome string, error string"


def arrivals(spark: SparkSession, folder: str, encoding: str = "utf-8", files_per_batch: int = 10_000) -> DataFrame:
    """A stream of the rows (``gridfile.SCHEMA``) of all files below ``folder``, now and later."""
    "".encode(encoding)
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = reader.option("recursiveFileLookup", True).option("pathGlobFilter", gridfile.SUFFIX_GLOB).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return gridfile.parsed(files, folder, encoding)


def run_new(spark: SparkSession, source: str, target: str, log: str, op: Callable[[DataFrame], DataFrame], encoding: str = "utf-8", files_per_batch: int = 10_000) -> DataFrame:
    """Apply ``op`` to the intervals of all files below ``source`` that earlier runs with the same ``log`` have not taken up, and write a file for each grid below ``target``.

    Gives the outcomes of all batches so far (batch, grid_id, outcome, error): ``written``, ``invalid``, or ``unreadable``. ``op`` works on
    grids by themselves, so that the batch in which a file comes makes no difference. Point tiers do not pass through ``op`` and are left out.
    A file that changes after it was taken up is not taken up again.
    """

    def write(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        plan = gridfile.write_grids(op(gridfile.intervals(rows)), target, encoding=encoding)
        lost = rows.where("error is not null").selectExpr("grid_id", "'unreadable' AS outcome", "error")
        plan.select("grid_id", "outcome", "error").unionByName(lost).write.mode("overwrite").parquet(f"{log}/outcomes/batch={number}")
        rows.unpersist()

    stream = arrivals(spark, source, encoding, files_per_batch).writeStream.foreachBatch(write)
    stream.option("checkpointLocation", f"{log}/commits").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUTCOMES).parquet(f"{log}/outcomes").select("batch", "grid_id", "outcome", "error")
