"""Smaller sources and sinks: path lists, mappings, dictionaries, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import written
from .files import copy_files


def read_mapping(spark: SparkSession, path: str) -> dict[str, str]:
    """A JSON object of texts. It is a parameter of an operator, so it is read whole."""
    import json

    text = spark.read.text(path, wholetext=True).first()
    return json.loads(text[0]) if text else {}


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """(position, path): the distinct lines of a file in order of their first occurrence. Empty lines are an error row with a null path."""
    lines = spark.read.text(path).withColumn("position", F.monotonically_increasing_id())
    return lines.groupBy(F.nullif("value", F.lit("")).alias("path")).agg(F.min("position").alias("position"))


def import_files(spark: SparkSession, path: str, folder: str, relative_to: str | None = None) -> DataFrame:
    """Copy the files that the lines of ``path`` name below ``folder``: (position, path, name, size), a row per line that is no repeat.

    Repeated lines count once, at their first place. A file keeps its own name or, with ``relative_to``, its path below that folder. The first line, in the order of the list,
    that is empty, names no readable file or is not below ``relative_to`` ends the import with a ValueError, before anything is copied. Of files
    with one name the last stays.
    """
    paths = written(read_paths(spark, path))
    if relative_to is None:
        name = F.element_at(F.split("path", "/"), -1)
    else:
        base = relative_to.rstrip("/") + "/"
        name = F.when(F.startswith("path", F.lit(base)), F.substr("path", F.lit(len(base) + 1)))
    named = paths.withColumn("name", name)
    if bad := named.where("path is null or name is null").orderBy("position").first():
        raise ValueError(f"line {bad['position']} of the list is empty or not below {relative_to}: {bad['path']}")
    last = named.withColumn("_last", F.max("position").over(W.partitionBy("name"))).where("position = _last")
    sizes = copy_files(last, folder, order="position")
    return named.join(sizes, "name").select("position", "path", "name", "size")


def file_sets(first: DataFrame, second: DataFrame, by: str = "grid_id") -> DataFrame:
    """(by, found): ``both`` for ids in both tables, else the ``first`` or ``second`` alone."""
    a = first.select(by).distinct().withColumn("_a", F.lit(True))
    b = second.select(by).distinct().withColumn("_b", F.lit(True))
    return a.join(b, by, "full").select(by, F.when(F.col("_a").isNull(), "second").when(F.col("_b").isNull(), "first").otherwise("both").alias("found"))


def read_dictionary(spark: SparkSession, path: str, weights: bool = False, comment: str = ";;;", numbered: bool = True) -> DataFrame:
    """(word, pronunciation, weight) from lines ``word  [weight  ]part part``; parted by white space.

    Lines that start with ``comment`` and, with ``numbered``, the (2) behind repeated words are passed over.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where(~F.startswith("line", F.lit(comment)) & (F.col("line") != ""))
    parts = F.split("line", r"\s+")
    word = F.regexp_replace(parts[0], r"\(\d+\)$", "") if numbered else parts[0]
    first = 3 if weights else 2
    weight = F.try_to_number(parts[1], F.lit("999999999999")).cast("long") if weights else F.lit(1).cast("long")
    return lines.select(word.alias("word"), F.slice(parts, first, F.greatest(F.lit(0), F.size(parts) - first + 1)).alias("pronunciation"), weight.alias("weight"))


def dictionary_lines(dictionary: DataFrame) -> DataFrame:
    """(value): ``word  weight  part part`` sorted by word, falling weight and pronunciation."""
    ordered = dictionary.orderBy("word", F.desc("weight"), "pronunciation")
    return ordered.select(F.concat_ws("  ", "word", F.col("weight").cast("string"), F.array_join("pronunciation", " ")).alias("value"))


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """Write ``dictionary_lines`` as text files, in order of their names; ``read_dictionary`` with weights gives the same dictionary back.

    Words and parts hold no white space (``dictionary.with_spaces``) and no word starts with the comment sign or ends in (1), (2)...
    """
    dictionary_lines(dictionary).write.mode("overwrite").text(path)


def write_csv(table: DataFrame, path: str, sep: str = ",") -> None:
    table.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
