"""Mixing sources to target weights along a time-varying curriculum.

A source's weight is a schedule over training time t in [0, 1]. Its integral is
the source's cumulative demand for words; a document that holds the words
[c, c + size) of its source's stream is placed at the time at which the demand
reaches the middle of that span. Schedules here are lines whose mean is the
source's share, so integral and inverse are closed forms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, target, slope) from ``sizes`` (source, source_size): ``share`` of all words by weight, no source above ``limit`` times its size.

    Weights repeat along the sources in code point order, null last. What a full source leaves goes to the others by
    weight until none is above its limit: sources fill in the order of limit / weight, so running sums along that order tell which are full.
    Slopes of the schedules run from rising to falling in source order. Null is a source like any other; other columns of ``sizes`` are left out,
    whatever their names; sources must not repeat; no sources give no rows. A row per source passes through one task, as sorted
    windows that stream.
    """
    spread = F.array(*[F.lit(w) for w in weights])
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    n_sources = F.count(F.lit(1)).over(W.partitionBy())
    rank = F.row_number().over(by_name) - 1
    named = sizes.withColumn("_w", F.get(spread, (rank % len(weights)).cast("int"))).withColumn("slope", F.when(n_sources < 2, 0.0).otherwise(1.6 * rank / (n_sources - 1) - 0.8))
    cap = limit * F.col("source_size").cast("double")
    capped = named.withColumn("_cap", cap).withColumn("_total", share * F.sum("source_size").over(W.partitionBy()))
    by_fill = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    gone = F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_w").over(by_fill.rowsBetween(W.currentRow, W.unboundedFollowing))
    over = capped.withColumn("_over", (F.col("_total") - gone) * F.col("_w") / open_weight > F.col("_cap"))
    full = over.withColumn("_full", F.min(F.col("_over").cast("int")).over(by_fill.rowsBetween(W.unboundedPreceding, W.currentRow)) == 1)
    everywhere = W.partitionBy()
    filled = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everywhere), F.lit(0.0))
    rest = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(everywhere)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise((F.col("_total") - filled) * F.col("_w") / rest)
    return full.select("source", "source_size", target.alias("target"), "slope")


def position(share: Column, slope: Column) -> Column:
    """The time t at which a schedule 1 + slope * (2t - 1) has given ``share`` of its words: the inverse integral.

    The integral is (1 - slope) t + slope t^2; |slope| < 1 keeps it rising.
    """
    b = 1 - slope
    return F.when(F.abs(slope) < 1e-12, share).otherwise(2 * share / (b + F.sqrt(b * b + 4 * slope * share)))


def order_key(doc_id: Column, source: Column) -> Column:
    """The fixed hashed order of a source's documents: 60 bits of an MD5."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, text: str = "text", out: str = "mix", rows_per_bucket: int = 2000, carry: bool = True) -> DataFrame:
    """Decide for every document how often the mix takes it, and when.

    Appends the struct ``out``: size, source_size, target, taken and positions (one training time per copy). All columns
    of ``docs`` stay, whatever their names; only one named like ``out`` gives way. Without ``carry`` the text is left out.

    Each source's stream repeats its documents in one fixed hashed order. Copies are taken whole: all that end before the
    source's target, and one more, untaken so far, whose size comes nearest to what is left (ties to the earlier one), if
    that is nearer to the target than none. No document is taken more than ``limit`` times (rounded down).
    Repeated and tied rows are rows of their own; null and empty texts have size 0 and are never taken; null is a source like
    any other; an empty table gives an empty result.

    Running sums are taken in two steps, over (source, range of hashes) totals and inside a range, so that no task holds a
    whole source, and words are counted once. Nothing but a row count comes to the driver.
    """
    docs = docs.drop(out)
    kept = [c for c in docs.columns if carry or c != text]
    whole_row = F.struct(*[F.col(c) for c in kept]).alias("r")
    key = order_key(F.col("doc_id"), F.col("source"))
    buckets = max(1, -(-docs.count() // rows_per_bucket))
    place = [
        F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit(""))).alias("s"), F.col("source").alias("name"), F.col("doc_id").alias("d"),
        word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("k"), key.alias("h"), F.floor(key.cast("double") * (buckets / 2.0**60)).alias("b"),
    ]
    slim = materialise(docs.select(*place, *([] if carry else [whole_row])))
    per = slim.groupBy("s", "b").agg(F.max("name").alias("name"), F.sum("size").alias("n"))
    sources = per.groupBy("s").agg(F.max("name").alias("source"), F.sum("n").cast("long").alias("source_size"))
    plan = targets(sources.select("source", "source_size"), weights, share, limit)
    plan = plan.select(F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit(""))).alias("s"), "source_size", "target", "slope")
    before = (F.sum("n").over(W.partitionBy("s").orderBy("b")) - F.col("n")).alias("before")
    offsets = per.select("s", "b", before).join(plan, "s")

    order = W.partitionBy("s", "b").orderBy("h", F.col("d").asc_nulls_first(), "size", "k")
    inside = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    size, n, target = F.col("size"), F.col("source_size"), F.col("target")
    at = lambda k: F.col("ahead") + k * n
    fits = lambda k: (size > 0) & (at(k) + size <= target)
    copies = range(int(limit))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("inside", inside).join(offsets, ["s", "b"]).withColumn("ahead", F.col("before") + F.col("inside")).drop("inside", "before")

    end = F.greatest(F.lit(0), *[F.when(fits(k), at(k) + size) for k in copies]).alias("end")
    known = materialise(placed(slim).select("*", end))
    ends = known.select("s", "b", "size", "target", "ahead", "source_size", "end")
    reached = ends.groupBy("s").agg(F.max("end").alias("reached"))
    left = target - F.col("reached")
    free = (size > 0) & (at(copies[-1]) + size > target) & (size < 2 * left)
    nearest = F.struct(F.abs(left - size).alias("miss"), "ahead")
    places = per.select("s", "b").join(reached, "s")  # joined by (source, bucket), so that no source is one task's work
    filler = ends.join(places, ["s", "b"]).where(free).groupBy("s").agg(F.min(nearest).alias("f"))
    fill = places.join(filler.select("s", F.col("f.ahead").alias("fill")), "s", "left")

    final = (placed(docs.select(*place, whole_row)) if carry else known).join(fill, ["s", "b"])
    is_fill = lambda k: (size > 0) & (F.col("ahead") == F.col("fill")) & ~fits(k) & (fits(k - 1) if k else F.lit(True))
    takes = lambda k: fits(k) | F.coalesce(is_fill(k), F.lit(False))
    begin = lambda k: F.when(fits(k), at(k)).otherwise(F.col("reached"))
    spot = lambda k: F.when(takes(k), position(F.least(F.lit(1.0), (begin(k) + size / 2) / target), F.col("slope")))
    taken = reduce(lambda a, b: a + b, [F.when(takes(k), size).otherwise(0) for k in copies]).cast("long")
    spots = F.array_compact(F.array(*[spot(k) for k in copies]))
    decided = F.struct(size.alias("size"), n.alias("source_size"), target.alias("target"), taken.alias("taken"), spots.alias("positions"))
    return final.select("r", decided.alias("m")).select(*[F.col("r").getField(c).alias(c) for c in kept], F.col("m").alias(out))


def schedule(mixed: DataFrame, out: str = "mix") -> DataFrame:
    """One row per taken copy, range-sorted by its training time: the order of training.

    The struct ``out`` of ``mix`` gains ``position`` (the copy's time) and ``copy`` (its number, from 0) in the place of
    positions; all other columns stay. Documents that are not taken have no row; ties in time follow doc_id and copy.
    """
    rows = mixed.where(F.size(F.col(out)["positions"]) > 0)
    each = F.posexplode(F.col(out)["positions"])
    spread = rows.select(F.struct(*[F.col(c) for c in mixed.columns]).alias("r"), each.alias("c", "p"))
    old = F.col("r")[out]
    placed = F.struct(*[old[f].alias(f) for f in ("size", "source_size", "target", "taken")], F.col("p").alias("position"), F.col("c").alias("copy"))
    sort = [F.col("p"), F.col("r")["doc_id"], F.col("c")]
    ordered = spread.repartitionByRange(*sort).sortWithinPartitions(*sort)
    return ordered.select(*[F.col("r")[c].alias(c) for c in mixed.columns if c != out], placed.alias(out))


def numbered(scheduled: DataFrame, out: str = "mix") -> DataFrame:
    """``scheduled`` with its place in the order of training, from 0, as ``rank`` of the struct ``out``.

    The range-sorted rows are written with their place inside their partition; the partitions' sizes, a row for each, are summed
    up in order and added. So the order is used where it was made, and no task sees all rows.
    """
    placed = materialise(scheduled.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("_before"))
    ranked = placed.join(F.broadcast(before), "_part")  # a row for each partition of the range sort
    return ranked.withColumn(out, F.col(out).withField("rank", F.col("_before") + F.col("_place"))).select(*scheduled.columns)
