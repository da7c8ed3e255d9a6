"""Greedy packing without a fold: where each chunk would end is looked up for all rows at once, then the chunks that count are found by jumping.

A chunk that starts at a row ends before the first row that reaches beyond its start by more than the limit. That successor
is an as-of lookup on running times (``lookup.asof``). Rows are numbered, and blocks of BLOCK numbers hold
their successors as one array. Inside a block, pointers are doubled in the array until they leave it; between blocks,
only rows at which a block can be entered are left, and their pointers are doubled by joins, so a tier of n rows takes
about log2(n / BLOCK) small joins. Each block is then walked from the row at which it is entered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEY, written
from .lookup import asof, numbered

#: Rows of a block: the length of the arrays that are walked.
BLOCK = 2048


def chunk_starts(rows: DataFrame, longest: float, width: float | None = None) -> DataFrame:
    """(grid_id, tier_idx, t): the start times of the chunks into which ``rows`` (grid_id, tier_idx, idx, t0, t1) are packed greedily.

    From a chunk's first start to its last end it lasts ``longest`` at most, but for a single row that is longer. Times are exact numbers
    (long ticks) that rise along a tier. ``width`` (of time, see ``lookup.asof``) spreads a long tier over tasks.
    """
    ranked = numbered(rows.select(*KEY, "t0", "t1"), KEY, "t0", "k", width)
    reach = F.greatest(F.col("t0") + F.lit(longest).cast(rows.schema["t0"].dataType), F.col("t1"))
    ahead = asof(ranked, ranked.select(*KEY, F.col("t1").alias("t"), F.col("k").alias("next")), KEY, reach, "t", "_n", after=True, strict=True, width=width, ties=["next"])
    of_block = F.array_sort(F.collect_list(F.struct("k", F.col("_n.next").alias("next"), "t0")))
    blocks = ahead.groupBy(*KEY, F.expr(f"k div {BLOCK}").alias("block")).agg(of_block.alias("r"))
    blocks = written(blocks.withColumn("rel", F.expr(f"transform(r, x -> x.next - block * {BLOCK}L)")))
    entered = _entries(blocks)
    walk = (
        "aggregate(sequence(0, size(rel) - 1), named_struct('at', coalesce(entry, -1L), 'found', cast(array() as array<int>)), "
        "(s, i) -> if(i = s.at, named_struct('at', coalesce(rel[i], -1L), 'found', array_append(s.found, i)), s), s -> s.found)"
    )
    walked = blocks.join(entered, [*KEY, "block"], "left").withColumn("entry", F.coalesce("entry", F.when(F.col("block") == 0, 0)).cast("long"))
    return walked.select(*KEY, "r", F.explode(F.expr(walk)).alias("i")).select(*KEY, F.expr("r[i].t0").alias("t"))


def _entries(blocks: DataFrame) -> DataFrame:
    """(grid_id, tier_idx, block, entry): the place of the first chunk start in each block but the first. Blocks without a start have no row."""
    leaving = f"exists(rel, x -> x >= {BLOCK})"
    jumped = f"aggregate(sequence(1, {BLOCK.bit_length()}), rel, (e, i) -> transform(e, x -> if(x < {BLOCK}, e[cast(x as int)], x)))"
    exits = blocks.where(leaving).select(*KEY, "block", F.posexplode(F.expr(jumped)).alias("i", "to")).where(F.col("to").isNotNull())
    every = exits.select(*KEY, (F.col("block") * BLOCK + F.col("i")).alias("k"), (F.col("block") * BLOCK + F.col("to")).alias("to"))
    every = written(every)
    targets = every.select(*KEY, F.col("to").alias("k")).distinct()
    reached = every.where("k = 0").select(*KEY, "k")
    jumps = written(every.join(targets, [*KEY, "k"], "left_semi").unionByName(every.where("k = 0")))
    while not jumps.isEmpty():
        ahead = jumps.select(*KEY, F.col("k").alias("to"), F.col("to").alias("beyond"))
        reached = written(reached.unionByName(reached.join(jumps, [*KEY, "k"]).select(*KEY, F.col("to").alias("k"))).distinct())
        jumps = written(jumps.join(ahead, [*KEY, "to"]).select(*KEY, "k", F.col("beyond").alias("to")))
    return reached.where("k > 0").select(*KEY, F.expr(f"k div {BLOCK}").alias("block"), (F.col("k") % BLOCK).alias("entry"))
