"""A corpus pipeline of four stages: quality, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and is written as Parquet and read again
before the next. All but the last return the columns of documents. Null and
empty texts are documents like others; an empty table passes through all stages;
columns beside doc_id, text and source are carried whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklane.llm import bpe, classifier, minhash, mixing
from marklane.llm.common import materialise, table
from marklane.llm.entry import quality_model, tokenizer


def _fresh(name: str) -> str:
    """A column name that no caller has."""
    return f"_{name}_{uuid.uuid4().hex}"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good. Labels come from the label table, texts from ``docs``.

    Every row is decided by its text alone, so repeated rows stay or go together; null and empty texts are scored as one empty passage.
    """
    score = _fresh("score")
    scored = classifier.score(docs, quality_model(spark, docs, sf_dir), out=score)
    return scored.where(F.col(score) >= classifier.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id (null last, ties by a hash of the row).

    Rows that repeat a doc_id are judged by their texts: unlike ones all stay. Texts without words are in no group and stay, repeated or not.
    """
    key = _fresh("key")
    keyed = docs.withColumn(key, F.xxhash64(*docs.columns))
    found = materialise(minhash.near_duplicates(keyed, carry=(key,)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(key).alias("k"))).alias("first")
    heads = found.where("group_id is not null").groupBy("group_id").agg(first).select(F.col("first.doc_id").alias("d"), F.col("first.k").alias("k"))
    no_words = F.coalesce(~F.col("text").rlike(mixing.WORD), F.lit(True))
    stay = keyed.where(~no_words).join(heads, keyed["doc_id"].eqNullSafe(heads["d"]) & (keyed[key] == heads["k"]), "left_semi").dropDuplicates(["doc_id", key])
    return stay.unionByName(keyed.where(no_words)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: every taken copy of a document is a row, whole; the files hold the rows in curriculum order.

    Documents that the mix does not take have no row; those without words are never taken.
    """
    out = _fresh("mix")
    return mixing.schedule(mixing.mix(docs, out=out), out).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, whether they decode to its text, and its place in the training order; null texts have no ids.

    ``mixture`` is range-sorted and a file is written for each range, numbered in order of the ranges; so ``file`` and ``row`` (its
    number in the file), which are read with the row, are the curriculum order however files are packed into tasks.
    Both are null for rows that are not read from files.
    """
    try:
        place = docs.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # not read from files
        place = docs.withColumns({"file": F.lit(None).cast("string"), "row": F.lit(None).cast("long")})
    coded = bpe.round_trip(place.select("doc_id", "source", "text", "file", "row"), tokenizer("byte_bpe_50k.json"), decoded=None)
    return coded.select("doc_id", "source", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids", "exact", "file", "row")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
