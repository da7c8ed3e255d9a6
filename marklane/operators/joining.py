"""Joining neighbouring intervals: each operator says where a new chunk begins; chunks are then merged."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import COLUMNS, KEY, TIER, P, duration, in_marks, is_pause, on_tiers, reindexed, stream_tiers, text_of
from . import packing
from .lookup import asof

# Punctuation that joins to its neighbour by default, and marks that never take any.
JOIN_SYMBOLS = list("!\"#$%&'()*+,-./:;<=>?@[\\]{}~`、。？！：；।¿¡【】，…‥「」『』〝〟″⟨⟩♪・‹›«»～′“”")
IGNORE_SYMBOLS = ["", " "]


def merge_chunks(chunked: DataFrame, join_with: str = " ", keep_empty: bool = False) -> DataFrame:
    """One interval for each ``chunk`` of a tier: first start, last end, marks joined in order.

    Empty marks are left out of the joined mark unless ``keep_empty``; null marks are empty. Chunk numbers rise along a tier.
    """
    marks = F.transform(F.array_sort(F.collect_list(F.struct("idx", text_of().alias("m")))), lambda x: x["m"])
    if not keep_empty:
        marks = F.filter(marks, lambda m: m != "")
    merged = chunked.groupBy(*TIER, "chunk").agg(F.min_by("t0", "idx").alias("t0"), F.max_by("t1", "idx").alias("t1"), F.array_join(marks, join_with).alias("mark"))
    return reindexed(merged.withColumn("idx", F.col("chunk")))


def chunks_by(starts: Column, df: DataFrame) -> DataFrame:
    """Number chunks by the rows at which one starts."""
    return df.withColumn("chunk", F.sum(F.when(starts, 1).otherwise(0)).over(P()).cast("long"))


def _first() -> Column:
    return F.row_number().over(P()) == 1


def join_all(intervals: DataFrame, tiers: list[str] | None = None, join_with: str = " ", keep_empty: bool = False) -> DataFrame:
    """Whole tiers become one interval."""
    return on_tiers(intervals, tiers, lambda d: merge_chunks(d.withColumn("chunk", F.lit(0).cast("long")), join_with, keep_empty))


def _between(df: DataFrame, hit: Column, threshold: float) -> DataFrame:
    flagged = df.withColumn("_hit", hit)
    change = F.coalesce(F.col("_hit") != F.lag("_hit").over(P()), F.lit(True))
    runs = flagged.withColumn("_run", F.sum(F.when(change, 1).otherwise(0)).over(P()))
    solo = runs.withColumn("_solo", F.col("_hit") & (F.sum(duration()).over(W.partitionBy(*KEY, "_run")) > threshold))
    return chunks_by(F.col("_solo") | F.coalesce(F.lag("_solo").over(P()), F.lit(True)), solo).drop("_hit", "_run", "_solo")


def join_between_marks(intervals: DataFrame, marks: list[str], ignore_below: float = 0, tiers: list[str] | None = None, join_with: str = " ", keep_empty: bool = False) -> DataFrame:
    """Join what lies between runs of the given marks.

    A run no longer than ``ignore_below`` in all is joined too; the members of a longer one stay single.
    """
    if ignore_below < 0:
        raise ValueError("the threshold must not be negative")
    return on_tiers(intervals, tiers, lambda d: merge_chunks(_between(d, in_marks(marks), ignore_below), join_with, keep_empty))


def join_between_pauses(intervals: DataFrame, pause: float = 0, tiers: list[str] | None = None, join_with: str = " ", keep_empty: bool = False) -> DataFrame:
    """The same with pauses in the place of marks."""
    if pause < 0:
        raise ValueError("the pause must not be negative")
    return on_tiers(intervals, tiers, lambda d: merge_chunks(_between(d, is_pause(), pause), join_with, keep_empty))


def boundaries(intervals: DataFrame, tier: str) -> DataFrame:
    """(grid_id, t): the distinct start and end times of a tier."""
    of = intervals.where(F.col("tier_name") == tier)
    return of.select("grid_id", F.explode(F.array("t0", "t1")).alias("t")).distinct()


def _at_boundary(df: DataFrame, bounds: DataFrame) -> DataFrame:
    marks = bounds.select("grid_id", F.col("t").alias("t0"), F.lit(True).alias("_bound"))
    return df.join(marks, ["grid_id", "t0"], "left").withColumn("_bound", F.coalesce("_bound", F.lit(False)))


def join_by_boundary(intervals: DataFrame, boundary_tier: str, tiers: list[str], join_with: str = " ", keep_empty: bool = False) -> DataFrame:
    """Join between successive boundaries of another tier.

    A grid whose boundary tier has no interval, or some boundary that a target tier lacks, stays as it is
    (``validation.missing_boundaries`` names those). As tiers have no gaps, a tier has all boundaries if an interval starts at each one
    but the last, and the last is one's start or the tier's end; so this is counted in the pass that finds the chunks.
    """
    of_grid = W.partitionBy("grid_id")
    bounds = boundaries(intervals, boundary_tier).withColumns({"_n": F.count(F.lit(1)).over(of_grid), "_end": F.max("t").over(of_grid)})

    def op(d: DataFrame) -> DataFrame:
        of_tier = W.partitionBy(*KEY)
        rows = d.join(bounds.withColumnRenamed("t", "t0"), ["grid_id", "t0"], "left").withColumn("_bound", F.col("_n").isNotNull())
        at_end = (F.max("t1").over(of_tier) == F.max("_end").over(of_tier)).cast("int")
        has_all = F.sum(F.col("_bound").cast("int")).over(of_tier) + at_end == F.max("_n").over(of_tier)
        flagged = rows.withColumn("_all", F.coalesce(has_all, F.lit(False)))
        return merge_chunks(chunks_by(F.col("_bound") | ~F.col("_all"), flagged).select(*COLUMNS, "chunk"), join_with, keep_empty)

    return on_tiers(intervals, tiers, op)


def join_by_duration(intervals: DataFrame, longest: float = 10, include_pauses: bool = False, tiers: list[str] | None = None, join_with: str = " ", keep_empty: bool = False, width: float | None = None) -> DataFrame:
    """Pack neighbours greedily up to ``longest``.

    With ``include_pauses`` all durations count. Without, what is measured runs from a chunk's first to its last
    content, and pauses at its ends stay single. An interval that is too long by itself is a chunk of its own.

    Ticks are packed by lookups and jumps (``packing.chunk_starts``; ``width`` of time spreads a long tier over tasks). With doubles every sum of durations is
    rounded, so that the result depends on the order of adding: those are folded from left to right, a row at a time.
    """
    if longest <= 0:
        raise ValueError("the duration must be positive")
    exact = isinstance(intervals.schema["t0"].dataType, T.IntegralType)

    def op(d: DataFrame) -> DataFrame:
        rows = d.withColumn("_pause", F.lit(False) if include_pauses else is_pause())
        packed = _packed(rows, longest, width) if exact else _folded(rows, longest, include_pauses)
        if not include_pauses:
            by = W.partitionBy(*KEY, "chunk")
            inside = F.when(~F.col("_pause"), F.col("idx"))
            lo, hi = F.min(inside).over(by), F.max(inside).over(by)
            core = packed.withColumn("_in", F.coalesce((F.col("idx") >= lo) & (F.col("idx") <= hi), F.lit(False)))
            start = ~F.col("_in") | ~F.coalesce(F.lag("_in").over(P()), F.lit(False)) | (F.col("chunk") != F.lag("chunk").over(P()))
            packed = chunks_by(start, core.withColumn("_c", F.col("chunk")).drop("chunk").withColumnRenamed("_c", "chunk"))
        return merge_chunks(packed.select(*COLUMNS, "chunk"), join_with, keep_empty)

    return on_tiers(intervals, tiers, op)


def _packed(rows: DataFrame, longest: float, width: float | None) -> DataFrame:
    """Append ``chunk``, the start time of the chunk of each row; -1 and less for pauses before all contents."""
    content = rows.where(~F.col("_pause"))
    if longest >= 2**62:
        starts = content.groupBy(*KEY).agg(F.min("t0").alias("t"))
    else:
        starts = packing.chunk_starts(content, math.floor(longest), width)
    found = asof(rows, starts, KEY, F.col("t0"), "t", "_c", width=width)
    return found.withColumn("chunk", F.coalesce(F.col("_c.t").cast("long"), F.lit(-(2**63)).cast("long"))).drop("_c")


def _folded(rows: DataFrame, longest: float, include_pauses: bool) -> DataFrame:
    """Append ``chunk`` by a fold that adds durations in their order."""

    def all_counts():
        total, chunk = None, 0

        def fold(d, pause):
            nonlocal total, chunk
            if total is not None and total + d <= longest:
                total += d
            else:
                total, chunk = d, chunk + 1
            return chunk

        return fold

    def content_counts():
        content, pending, seen, chunk, begun = 0, 0, False, 0, False

        def fold(d, pause):
            nonlocal content, pending, seen, chunk, begun
            new = content if pause else content + pending + d if seen else d
            if begun and new <= longest:
                content, pending, seen = (content, pending + d, seen) if pause else (new, 0, True)
            else:
                chunk, begun = chunk + 1, True
                content, pending, seen = (0, d, False) if pause else (d, 0, True)
            return chunk

        return fold

    step = all_counts if include_pauses else content_counts
    return stream_tiers(rows.withColumn("_d", duration()), ["_d", "_pause"], step, T.StructField("chunk", T.LongType()))


def join_marks(intervals: DataFrame, marks: list[str], empty: bool = False, tiers: list[str] | None = None, join_with: str = " ", keep_empty: bool = False) -> DataFrame:
    """Join neighbours that are pauses (with ``empty``) or have one of the marks."""
    if not marks and not empty:
        raise ValueError("no mark is given")

    def op(d: DataFrame) -> DataFrame:
        flagged = d.withColumn("_hit", F.when(is_pause(), F.lit(empty)).otherwise(in_marks(marks)))
        start = ~F.col("_hit") | ~F.coalesce(F.lag("_hit").over(P()), F.lit(False))
        return merge_chunks(chunks_by(start, flagged).drop("_hit"), join_with, keep_empty)

    return on_tiers(intervals, tiers, op)


def join_symbols(intervals: DataFrame, mode: str = "right", symbols: list[str] | None = None, ignore: list[str] | None = None, tiers: list[str] | None = None, join_with: str = "", keep_empty: bool = False) -> DataFrame:
    """Join symbols to a neighbour: ``right`` to the one before them, ``left`` to the one after, ``together`` with each other."""
    if mode not in ("right", "left", "together"):
        raise ValueError(f"no such mode: {mode}")
    symbols, ignore = JOIN_SYMBOLS if symbols is None else symbols, IGNORE_SYMBOLS if ignore is None else ignore

    def op(d: DataFrame) -> DataFrame:
        rows = d.withColumn("_join", in_marks(symbols))
        if mode == "together":
            start = ~F.col("_join") | ~F.coalesce(F.lag("_join").over(P()), F.lit(False))
            return merge_chunks(chunks_by(start, rows).drop("_join"), join_with, keep_empty)
        order = W.partitionBy(*KEY).orderBy("idx" if mode == "right" else F.desc("idx"))
        runs = rows.withColumn("_run", F.sum(F.when(F.col("_join"), 0).otherwise(1)).over(order))
        whole = W.partitionBy(*KEY, "_run")
        head = F.max(F.when(~F.col("_join") & ~in_marks(ignore), F.lit(True))).over(whole)
        kept = runs.withColumn("_kept", F.coalesce(head, F.lit(False)))
        change = F.coalesce(F.col("_run") != F.lag("_run").over(P()), F.lit(True))
        return merge_chunks(chunks_by(~F.col("_kept") | change, kept).select(*COLUMNS, "chunk"), join_with, keep_empty)

    return on_tiers(intervals, tiers, op)


#: Rows that are stepped through as one array, and such blocks whose functions are composed at once.
BLOCK, BLOCKS = 2048, 1024


def join_template(intervals: DataFrame, template: list[str], boundary_tier: str | None = None, tiers: list[str] | None = None, join_with: str = " ", keep_empty: bool = False) -> DataFrame:
    """Join each occurrence of a fixed sequence of marks, found from left to right.

    After a mismatch the search starts again at the present interval, without going back; an interval that starts on a
    boundary of ``boundary_tier`` begins anew.
    """
    if not 0 < len(template) < 31:
        raise ValueError("a template has 1 to 30 marks")
    n = len(template)
    bounds = boundaries(intervals, boundary_tier) if boundary_tier else None

    def op(d: DataFrame) -> DataFrame:
        rows = d.withColumn("_bound", F.lit(False)) if bounds is None else _at_boundary(d, bounds)
        ends = _template_ends(rows, template)
        ahead = F.max(F.col("_end").cast("int")).over(P().rowsBetween(0, n - 1)) == 1
        begins = F.coalesce(F.lead("_end", n - 1).over(P()), F.lit(False))
        return merge_chunks(chunks_by(~ahead | begins, ends).select(*COLUMNS, "chunk"), join_with, keep_empty)

    return on_tiers(intervals, tiers, op)


def _template_ends(rows: DataFrame, template: list[str]) -> DataFrame:
    """Append ``_end``: whether an occurrence ends at the row.

    The search is an automaton whose state is the number of marks found. A block of rows maps each state at its begin to one at
    its end; these functions are composed along the tier, first inside groups of blocks and then over the groups, and
    each block is stepped through again from the state that it begins with.
    """
    n = len(template)
    fits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(text_of() == m, 1 << i).otherwise(0) for i, m in enumerate(template)])
    coded = rows.withColumn("_x", F.when(F.col("_bound"), fits.bitwiseOR(F.lit(1 << n))).otherwise(fits))
    at = lambda k: f"if((x._x & {1 << n}) <> 0, 0, {k})"
    step = lambda k: f"if((x._x & shiftleft(1, {at(k)})) <> 0, ({at(k)} + 1) % {n}, if((x._x & 1) <> 0, {1 % n}, 0))"
    full = lambda k: f"(x._x & {1 << (n - 1)}) <> 0 and {at(k)} = {n - 1}"
    states = f"sequence(0, {n - 1})"
    held = F.array_sort(F.collect_list(F.struct("idx", *[c for c in coded.columns if c not in (*KEY, "idx")])))
    blocks = coded.groupBy(*KEY, F.expr(f"idx div {BLOCK}").alias("_b")).agg(held.alias("_r"))
    maps = blocks.select(*KEY, "_b", F.expr(f"transform({states}, k0 -> aggregate(_r, k0, (k, x) -> {step('k')}))").alias("f"))
    compose = "transform({0}, k0 -> aggregate({1}, k0, (k, g) -> g.f[k]))"
    groups = maps.groupBy(*KEY, F.expr(f"_b div {BLOCKS}").alias("_g")).agg(F.array_sort(F.collect_list(F.struct("_b", "f"))).alias("_of"))
    along = groups.withColumn("f", F.expr(compose.format(states, "_of"))).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("_g", "f", "_of"))).alias("_all"))
    begun = "aggregate({1}, named_struct('k', {0}, 'seen', cast(array() as array<int>)), (s, g) -> named_struct('k', g.f[s.k], 'seen', array_append(s.seen, s.k)), s -> s.seen)"
    by_group = along.select(*KEY, F.explode(F.arrays_zip("_all", F.expr(begun.format("0", "_all")).alias("k"))).alias("z")).select(*KEY, F.col("z._all._of").alias("_of"), F.col("z.k").alias("k0"))
    entered = by_group.select(*KEY, F.explode(F.arrays_zip("_of", F.expr(begun.format("k0", "_of")).alias("k"))).alias("z")).select(*KEY, F.col("z._of._b").alias("_b"), F.col("z.k").alias("_k"))
    ends = (
        f"aggregate(_r, named_struct('k', _k, 'i', 0, 'found', cast(array() as array<int>)), (s, x) -> named_struct('k', {step('s.k')}, 'i', s.i + 1, "
        f"'found', if({full('s.k')}, array_append(s.found, s.i), s.found)), s -> s.found)"
    )
    run = blocks.join(entered, [*KEY, "_b"]).select(*KEY, "_r", F.expr(ends).alias("_found"))
    flat = run.select(*KEY, "_found", F.posexplode("_r").alias("_i", "x"))
    return flat.select(*KEY, *[F.col("x")[c].alias(c) for c in coded.columns if c not in KEY], F.array_contains("_found", F.col("_i")).alias("_end"))


def content_runs(intervals: DataFrame) -> DataFrame:
    """(grid_id, tier_idx, run, is_content, first, last): alternating runs of contents and pauses."""
    rows = intervals.withColumn("is_content", ~is_pause())
    change = F.coalesce(F.col("is_content") != F.lag("is_content").over(P()), F.lit(True))
    runs = rows.withColumn("run", F.sum(F.when(change, 1).otherwise(0)).over(P()).cast("long"))
    return runs.groupBy(*KEY, "run", "is_content").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
