"""Exact order statistics of groups of any size, all groups at once.

Values are reduced to (value, count) pairs. The range that holds a wanted rank is cut at sampled pivots, the counts of the
parts tell which part holds the rank, and so on in rounds until no range has more than SMALL different values; then each range
is put together and the value read off. A round costs two passes over the pairs of the ranges that are still too large. The
driver sees one number for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import written

#: Different values that one range may have when it is put together, and the parts into which a larger one is cut.
SMALL, PARTS = 20_000, 256


def at_ranks(values: DataFrame, keys: list[str], v: str, ranks: list) -> DataFrame:
    """(keys..., n, stats): for each group of ``keys`` (equal nulls are one group) its number of values and the values at ``ranks`` in order.

    ``ranks``: functions from the column n to a rank, from 0; ranks outside of [0, n) give null. Null values do not count; groups
    without values have no row. Without keys all values are one group.
    """
    pairs = values.where(F.col(v).isNotNull()).groupBy(*keys, F.col(v).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    key = F.struct(*[F.coalesce(F.to_json(F.struct(k)), F.lit("{}")).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k0"))
    pairs = written(pairs.withColumn("_key", key))
    kind = pairs.schema["_v"].dataType
    most = pairs.groupBy("_key").count().agg(F.max("count")).first()[0]
    pick = (
        "aggregate(_of, named_struct('at', {before}, 'v', cast(null as " + kind.simpleString() + ")), (s, x) -> "
        "named_struct('at', s.at + x._c, 'v', if({rank} >= s.at and {rank} < s.at + x._c, x._v, s.v)), s -> s.v)"
    )
    whole = F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_of")
    asked = lambda n: F.array(*[r(n).cast("long") for r in ranks])
    if (most or 0) <= SMALL:  # each group is put together at once
        every = pairs.groupBy("_key").agg(whole, F.sum("_c").alias("n"), *[F.first(k).alias(k) for k in keys])
        return every.withColumn("_ranks", asked(F.col("n"))).select(*keys, "n", F.expr(f"transform(_ranks, r -> {pick.format(before='0L', rank='r')})").alias("stats"))
    groups = pairs.groupBy("_key").agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("_d"), *[F.first(k).alias(k) for k in keys])
    wanted = groups.select("_key", "n", "_d", *keys, F.posexplode(asked(F.col("n"))).alias("_i", "_rank"))
    nothing = F.lit(None).cast(kind)
    open_ = written(wanted.withColumns({"_lo": nothing, "_hi": nothing, "_before": F.lit(0).cast("long")}))
    while open_.agg(F.max("_d")).first()[0] > SMALL:
        open_ = written(_narrowed(pairs, open_))
    inside = open_.join(pairs.select("_key", "_v", "_c"), "_key").where(_within())
    ranged = inside.groupBy("_key", "_i").agg(F.first("_rank").alias("_rank"), F.first("_before").alias("_before"), whole)
    one = ranged.select("_key", "_i", F.expr(pick.format(before="_before", rank="_rank")).alias("_x"))
    stats = one.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("stats"))
    return groups.join(stats, "_key").select(*keys, "n", "stats")


def _within():
    """Whether a value lies in a range: above ``_lo``, up to ``_hi``; null is open."""
    return (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))


def _narrowed(pairs: DataFrame, open_: DataFrame) -> DataFrame:
    """``open_`` with the ranges of more than SMALL different values replaced by that part of them which holds the rank."""
    done, large = open_.where(f"_d <= {SMALL}"), open_.where(f"_d > {SMALL}")
    inside = large.join(pairs.select("_key", "_v", "_c"), "_key").where(_within())
    at = [i / PARTS for i in range(1, PARTS)]
    pivots = inside.groupBy("_key", "_i").agg(F.percentile_approx("_v", at, 20 * PARTS).alias("_p"))
    # the part of a value is the number of pivots below it
    part = F.size(F.filter("_p", lambda p: p < F.col("_v")))
    counts = inside.join(pivots, ["_key", "_i"]).groupBy("_key", "_i", part.alias("_part")).agg(F.sum("_c").alias("c"), F.count(F.lit(1)).alias("d"))
    parts = counts.groupBy("_key", "_i").agg(F.array_sort(F.collect_list(F.struct("_part", "c", "d"))).alias("_parts"))
    chosen = (
        "aggregate(_parts, named_struct('at', _before, 'part', -1, 'd', 0L, 'before', 0L), (s, x) -> if(_rank >= s.at and _rank < s.at + x.c, "
        "named_struct('at', s.at + x.c, 'part', x._part, 'd', x.d, 'before', s.at), named_struct('at', s.at + x.c, 'part', s.part, 'd', s.d, 'before', s.before)))"
    )
    narrow = large.join(parts, ["_key", "_i"]).join(pivots, ["_key", "_i"]).withColumn("_s", F.expr(chosen))
    lo, hi = F.coalesce(F.get("_p", F.col("_s.part") - 1), F.col("_lo")), F.coalesce(F.get("_p", F.col("_s.part")), F.col("_hi"))
    return done.unionByName(narrow.withColumns({"_lo": lo, "_hi": hi, "_before": F.col("_s.before"), "_d": F.col("_s.d")}).select(*open_.columns))
