"""Moving boundaries: fixing, syncing, removing spans, merging grids."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import batched, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import COLUMNS, KEY, reindexed, to_arrow, written
from .joining import boundaries
from .rounding import exact_round
from .selection import last_span


def _swept(target: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """The intervals of ``target`` with their boundaries moved to the timepoints (grid_id, t) of their grid, one tier after the other.

    Timepoints are taken in order, and each moves the nearer edge of the interval around it, if within ``threshold`` (a tie moves the start; before the first
    and behind the last edge the distance must be below it). Each sees what the ones before it moved. Edges and timepoints
    that follow each other at more than the threshold cannot influence each other, so the order of times is cut there into islands,
    which are swept apart, in any number of tasks. Without a limit a tier is one island. A sweep streams: it holds the timepoints up to the next edge.
    Intervals that do not last any more go.
    """
    kind = target.schema["t0"].dataType
    along = W.partitionBy(*KEY).orderBy("idx")
    last = F.lead("idx").over(along).isNull()
    edge = lambda t, k, final: F.struct(F.col(t).alias("t"), k.cast("long").alias("k"), final.alias("final"))
    ranked = target.withColumn("_k", F.row_number().over(along) - 1).withColumn("_last", last)
    both = F.when(F.col("_last"), F.array(edge("t0", F.col("_k"), F.lit(False)), edge("t1", F.col("_k") + 1, F.lit(True)))).otherwise(F.array(edge("t0", F.col("_k"), F.lit(False))))
    edges = ranked.select(*KEY, F.explode(both).alias("e")).select(*KEY, "e.t", "e.k", "e.final")
    times = target.select(*KEY).distinct().join(points, "grid_id").select(*KEY, F.col("t").cast(kind).alias("t"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("boolean").alias("final"))
    items = edges.unionByName(times)
    ordered = W.partitionBy(*KEY).orderBy("t", F.col("k").asc_nulls_last())
    if threshold == math.inf:
        items = items.withColumn("_island", F.lit(0).cast("long"))
    else:
        apart = F.coalesce(F.col("t") - F.lag("t").over(ordered) > threshold, F.lit(False))
        items = items.withColumn("_island", F.sum(apart.cast("long")).over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)))
    numbered = items.select(*KEY, "_island", "t", "k", "final")
    at = [numbered.columns.index(c) for c in (*KEY, "_island")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        names, types = moved.fieldNames(), [to_arrow(f.dataType) for f in moved.fields]
        for part in batched(((key[0], key[1], k, t) for key, of in groupby(rows, key=lambda r: tuple(r[i] for i in at)) for k, t in sweep(((r[3], r[4], r[5]) for r in of), threshold)), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*part, strict=True), types, strict=True)], names=names)

    moved = T.StructType([target.schema[KEY[0]], target.schema[KEY[1]], T.StructField("_k", T.LongType()), T.StructField("_t", kind)])
    spread = numbered.repartition(*KEY, "_island").sortWithinPartitions(*KEY, "_island", "t", F.col("k").asc_nulls_last())
    swept = spread.mapInArrow(run, moved)
    by_k = W.partitionBy(*KEY).orderBy("_k")
    ends = swept.withColumn("_to", F.lead("_t").over(by_k)).where("_to is not null")
    back = ranked.drop("t0", "t1", "_last").join(ends.withColumnsRenamed({"_t": "t0", "_to": "t1"}), [*KEY, "_k"])
    return reindexed(back.where("t0 < t1"))


def sweep(items: Iterable[tuple], threshold: float) -> Iterator[tuple]:
    """(k, t) of each edge, where it is in the end. ``items`` is one island in order of time: edges (t, k, final) with their number in the tier, and timepoints (t, None, None).

    Only the last edge that was passed can still move, so this is a scan with one edge in hand and the items up to the next one ahead.
    Edges of other islands are farther than the threshold.
    """
    ahead: deque = deque()  # items that were read but not yet passed
    source = iter(items)
    hand: tuple | None = None  # (k, t) of the last edge passed
    final = False  # it is the tier's last one
    pulled = 0  # edges among the items ahead that moved already

    def next_edge() -> tuple | None:
        """The first edge ahead that is not passed."""
        skip = pulled
        for item in ahead:
            if item[1] is not None:
                if not skip:
                    return item
                skip -= 1
        for item in source:
            ahead.append(item)
            if item[1] is not None:
                if not skip:
                    return item
                skip -= 1
        return None

    while True:
        if not ahead:
            if (item := next(source, None)) is None:
                break
            ahead.append(item)
        t, k, is_final = ahead.popleft()
        if k is not None:
            if pulled:
                pulled -= 1
                continue
            if hand is not None:
                yield hand
            hand, final = (k, t), is_final
            continue
        nearest = next_edge()
        if nearest is not None and nearest[0] == t or hand is not None and hand[1] == t:
            continue
        before = t - hand[1] if hand is not None else None
        behind = nearest[0] - t if nearest is not None else None
        if before is None and behind is None:
            continue
        if before is None:  # nothing before it in the island: the tier's first edge, or the rest is too far
            take_next = behind < threshold if nearest[1] == 0 else behind <= threshold
            take_hand = False
        elif behind is None:
            take_next = False
            take_hand = before < threshold if final else before <= threshold
        else:
            take_hand = before <= behind and before <= threshold
            take_next = before > behind and behind <= threshold
        if take_hand:
            hand = (hand[0], t)
        elif take_next:
            if hand is not None:
                yield hand
            hand, final = (nearest[1], t), nearest[2]
            pulled += 1
    if hand is not None:
        yield hand


def fix_boundaries(intervals: DataFrame, reference_tier: str, tiers: list[str], threshold: float = 0.005) -> DataFrame:
    """Move boundaries of the target tiers to those of the reference tier (see ``_swept``). Tiers without a reference stay as they are."""
    hit = F.coalesce(F.col("tier_name").isin(tiers), F.lit(False))
    target, rest = intervals.where(hit).select(*COLUMNS), intervals.where(~hit).select(*COLUMNS)
    return _swept(target, boundaries(intervals, reference_tier), threshold).unionByName(rest)


def with_audio(intervals: DataFrame, audio: DataFrame) -> DataFrame:
    """The intervals of grids that have audio (grid_id, n_samples, sample_rate), with those columns; ``tables.file_sets`` names the grids and recordings that miss the other."""
    return intervals.join(audio.select("grid_id", "n_samples", "sample_rate"), "grid_id")


def sync_to_audio(intervals: DataFrame, audio: DataFrame) -> DataFrame:
    """Start at 0 and end at the audio's length (grid_id, n_samples, sample_rate).

    A grid stays as it is if its audio is missing or ends at or before the start of some last interval.
    """
    whole = W.partitionBy(*KEY)
    ends = audio.select("grid_id", (F.col("n_samples") / F.col("sample_rate")).alias("_end"))
    rows = intervals.join(ends, "grid_id", "left").withColumns({"_lo": F.min("idx").over(whole), "_hi": F.max("idx").over(whole)})
    too_short = F.max(((F.col("idx") == F.col("_hi")) & (F.col("_end") <= F.col("t0"))).cast("int")).over(W.partitionBy("grid_id")) == 1
    rows = rows.withColumn("_ok", F.col("_end").isNotNull() & ~F.coalesce(too_short, F.lit(False)))
    t0 = F.when(F.col("_ok") & (F.col("idx") == F.col("_lo")), F.lit(0.0)).otherwise(F.col("t0"))
    t1 = F.when(F.col("_ok") & (F.col("idx") == F.col("_hi")), F.col("_end")).otherwise(F.col("t1"))
    return rows.withColumns({"t0": t0, "t1": t1}).select(*COLUMNS)


def merge_spans(spans: DataFrame) -> DataFrame:
    """(grid_id, lo, hi): touching and overlapping spans become one."""
    by = W.partitionBy("grid_id").orderBy("lo", "hi")
    gap = F.coalesce(F.col("lo") > F.max("hi").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    runs = spans.withColumn("_run", F.sum(F.when(gap, 1).otherwise(0)).over(by))
    return runs.groupBy("grid_id", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def usable_spans(intervals: DataFrame, spans: DataFrame) -> DataFrame:
    """(grid_id, lo, hi, upto): merged spans and the length cut up to each one's end, without those of grids in which an edge of a span is no boundary of some tier, or of which nothing would be left."""
    by = W.partitionBy("grid_id").orderBy("lo").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = merge_spans(spans).withColumn("upto", F.sum(F.col("hi") - F.col("lo")).over(by))
    edges = merged.select("grid_id", F.explode(F.array("lo", "hi")).alias("t")).distinct()
    have = intervals.select(*KEY, F.explode(F.array("t0", "t1")).alias("t")).distinct()
    lacking = intervals.select(*KEY).distinct().join(edges, "grid_id").join(have, [*KEY, "t"], "left_anti").select("grid_id").distinct()
    size = intervals.groupBy("grid_id").agg((F.max("t1") - F.min("t0")).alias("_size"))
    emptied = size.join(merged.groupBy("grid_id").agg(F.max("upto").alias("_cut")), "grid_id").where("_cut >= _size").select("grid_id")
    return merged.join(lacking, "grid_id", "left_anti").join(emptied, "grid_id", "left_anti")


def remove_spans(intervals: DataFrame, spans: DataFrame) -> DataFrame:
    """Cut spans (grid_id, lo, hi) out of all tiers and close the gaps.

    A kept interval moves to the left by the length that was cut before it. Grids whose spans cannot be cut (see ``usable_spans``) stay as they are.
    """
    by = W.partitionBy("grid_id")
    along = by.orderBy("lo").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = merge_spans(spans).withColumns({"upto": F.sum(F.col("hi") - F.col("lo")).over(along), "n": F.count(F.lit(1)).over(by), "cut": F.sum(F.col("hi") - F.col("lo")).over(by)})
    rows = last_span(intervals, merged)
    # what ``usable_spans`` asks for, in the same pass: an interval of every tier starts where a span starts and one ends where it ends
    of_tier = W.partitionBy(*KEY)
    meets = lambda t, edge: F.sum((F.col(t) == F.col(f"_span.{edge}")).cast("int")).over(of_tier)
    n, cut = F.max("_span.n").over(by), F.max("_span.cut").over(by)
    rows = rows.withColumn("_fits", (F.coalesce(meets("t0", "lo"), F.lit(0)) == n) & (F.coalesce(meets("t1", "hi"), F.lit(0)) == n) & (cut < F.max("t1").over(by) - F.min("t0").over(by)))
    rows = rows.withColumn("_ok", F.coalesce(F.min(F.col("_fits").cast("int")).over(by) == 1, F.lit(False)))
    kept = rows.where(~F.col("_ok") | F.col("_span").isNull() | (F.col("t1") > F.col("_span.hi")))
    shift = F.when(F.col("_ok"), F.coalesce(F.col("_span.upto"), F.lit(0))).otherwise(0)
    kinds = {f.name: f.dataType for f in intervals.schema.fields}
    return reindexed(kept.withColumns({"t0": (F.col("t0") - shift).cast(kinds["t0"]), "t1": (F.col("t1") - shift).cast(kinds["t1"])}))


def spans_with_marks(intervals: DataFrame, tier: str, marks: list[str], mode: str = "all") -> DataFrame:
    """(grid_id, lo, hi): spans of a tier's intervals to be removed; ``mode`` as in ``selection.at_ends``."""
    from .selection import at_ends

    return at_ends(intervals.where(F.col("tier_name") == tier), marks, mode).select("grid_id", F.col("t0").alias("lo"), F.col("t1").alias("hi"))


def merge_grids(intervals: DataFrame, merged_id, order: str = "grid_id", separator: tuple[float, str] | None = None) -> DataFrame:
    """Append grids tier by tier, times running on from 0; then move the boundaries of the other tiers to those of the first.

    ``merged_id`` is the column that names the merged grid; grids follow by ``order``. Tiers are matched by name, and
    their order is that of the first grid. ``separator``: (length, mark) of an interval between grids. Groups whose
    grids differ in their set of tier names give no rows; a group of one grid stays as it is. Running times are taken
    in two steps, inside a grid and over the grids' lengths.
    """
    rows = intervals.withColumn("_new", merged_id)
    # one row per grid and tier name decides all: which groups fit, the grids' and the tiers' order
    held = rows.groupBy("_new", "grid_id", "tier_name").agg(F.min("tier_idx").alias("_own"), F.first(order).alias("_order"))
    grids = held.groupBy("_new", "grid_id").agg(F.array_sort(F.collect_set("tier_name")).alias("_names"), F.first("_order").alias("_order"))
    same = grids.groupBy("_new").agg(F.countDistinct("_names").alias("_n"), F.count(F.lit(1)).alias("_grids")).where("_n = 1").drop("_n")
    places = grids.join(same, "_new").select("_new", "grid_id", "_grids", F.row_number().over(W.partitionBy("_new").orderBy("_order", "grid_id")).alias("_g"))
    numbered = held.join(places, ["_new", "grid_id"])
    first = F.max(F.when(F.col("_g") == 1, F.col("_own"))).over(W.partitionBy("_new", "tier_name"))
    plan = numbered.withColumn("_t", first).withColumn("_lead", F.min("_t").over(W.partitionBy("_new"))).select("_new", "grid_id", "tier_name", "_grids", "_g", "_t", "_lead")
    rows = rows.join(written(plan), ["_new", "grid_id", "tier_name"])
    alone = rows.where("_grids = 1").select(F.col("_new").alias("grid_id"), *COLUMNS[1:])
    rows = rows.where("_grids > 1").withColumn("_d", F.col("t1") - F.col("t0")).withColumn("_part", F.lit(1))
    rows = rows.select("_new", "tier_name", "_t", "_lead", "_g", "idx", "_d", "mark", "_part")
    if separator:
        edges = rows.select("_new", "tier_name", "_t", "_lead", "_g").distinct().where("_g > 1")
        gap = edges.select("_new", "tier_name", "_t", "_lead", "_g", F.lit(0).cast("long").alias("idx"), F.lit(separator[0]).cast(rows.schema["_d"].dataType).alias("_d"), F.lit(separator[1]).alias("mark"), F.lit(0).alias("_part"))
        rows = rows.unionByName(gap)
    inside = W.partitionBy("_new", "_t", "_g").orderBy("_part", "idx")
    timed = rows.withColumns({"_end": F.sum("_d").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)), "_k": F.row_number().over(inside)})
    lengths = timed.groupBy("_new", "_t", "_g").agg(F.max_by("_end", "_k").alias("_length"), F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy("_new", "_t").orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    starts = lengths.select("_new", "_t", "_g", F.coalesce(F.sum("_length").over(before), F.lit(0)).alias("_from"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_i"))
    placed = timed.join(starts, ["_new", "_t", "_g"])
    t1 = F.col("_from") + F.col("_end")
    t0 = F.col("_from") + F.coalesce(F.lag("_end").over(inside), F.lit(0))
    kind = intervals.schema["t1"].dataType
    out = placed.select(F.col("_new").alias("grid_id"), F.col("_t").alias("tier_idx"), "tier_name", (F.col("_i") + F.col("_k") - 1).cast("long").alias("idx"), t0.cast(kind).alias("t0"), t1.cast(kind).alias("t1"), "mark", (F.col("_t") == F.col("_lead")).alias("_leads"))
    out = written(out)
    reference, others = out.where("_leads").select(*COLUMNS), out.where("not _leads").select(*COLUMNS)
    points = reference.select("grid_id", F.explode(F.array("t0", "t1")).alias("t")).distinct()
    return alone.select(*COLUMNS).unionByName(reference).unionByName(_swept(others, points, math.inf))


def round_times(intervals: DataFrame, digits: int) -> DataFrame:
    """All times rounded to ``digits`` places, on the exact binary value and halves to even; times become doubles."""
    return intervals.withColumns({c: exact_round(F.col(c), digits) for c in ("t0", "t1")})


def samples_of(seconds: float, rate: int) -> int:
    """``rounding.samples`` of one value."""
    return math.ceil(round(seconds * rate, 4))
