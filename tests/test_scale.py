"""Operators for long tiers and large groups, cut into small blocks, against plain models of the whole."""

import bisect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marklane.operators import alignment, joining, lookup, orderstats, packing, selection, splitting
from marklane.plans import views

TICKS = "grid_id string, tier_idx int, tier_name string, idx long, t0 long, t1 long, mark string"


def ticked(lengths, marks, grid="g", name="a", k=0):
    at, rows = 0, []
    for i, (d, m) in enumerate(zip(lengths, marks, strict=True)):
        rows.append((grid, k, name, i, at, at + d, m))
        at += d
    return rows


def times(df, name="a"):
    return [(r["grid_id"], r["t0"], r["t1"], r["mark"]) for r in df.where(F.col("tier_name") == name).orderBy("grid_id", "tier_idx", "idx").collect()]


# --- as-of lookups


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("width", [None, 7])
def test_asof_against_a_search_of_all_points(spark, after, strict, width):
    rng = random.Random(1)
    points = [(g, rng.randrange(100), i) for i, g in enumerate("aab" * 12)] + [("c", None, 99), (None, 1, 98)]
    rows = [(g, rng.randrange(-20, 130), "clash") for g in "abcd" * 20] + [("a", None, "x"), ("a", 5, "twice"), ("a", 5, "twice")]
    got = lookup.asof(
        spark.createDataFrame(rows, "g string, at long, t string"), spark.createDataFrame(points, "g string, t long, k long"), ["g"], F.col("at"), "t", "p", after=after, strict=strict, width=width, ties=["k"]
    )

    def want(g, at):
        if at is None:
            return None
        fits = [(t, k) for h, t, k in points if h == g and t is not None and ((t > at or not strict and t == at) if after else (t < at or not strict and t == at))]
        return (min if after else max)(fits, default=None)

    found = sorted((r["g"], -1 if r["at"] is None else r["at"], r["t"], tuple(r["p"]) if r["p"] else None) for r in got.collect())
    assert found == sorted(((g, -1 if at is None else at, x, want(g, at)) for g, at, x in rows), key=lambda r: r[:3])


@pytest.mark.parametrize("width", [None, 3])
def test_enclosing_interval_is_clamped(spark, width):
    iv = spark.createDataFrame(ticked([2, 3, 4], "xyz"), TICKS)
    points = spark.createDataFrame([("g", 0, t) for t in (-5, 0, 1, 2, 4, 5, 8, 9, 30)] + [("none", 0, 1)], "grid_id string, tier_idx int, t long")
    got = {(r["grid_id"], r["t"]): r["_in"] and (r["_in"]["mark"], r["_in"]["clamped"]) for r in lookup.enclosing(points, iv, width=width).collect()}
    assert got == {("g", -5): ("x", True), ("g", 0): ("x", False), ("g", 1): ("x", False), ("g", 2): ("y", False), ("g", 4): ("y", False), ("g", 5): ("z", False), ("g", 8): ("z", False), ("g", 9): ("z", True), ("g", 30): ("z", True), ("none", 1): None}


def test_last_span_in_time_blocks(spark):
    iv = spark.createDataFrame(ticked([1] * 40, ["m"] * 40), TICKS)
    spans = spark.createDataFrame([("g", 3, 5), ("g", 30, 33)], "grid_id string, lo long, hi long")
    whole, blocks = (sorted(map(str, selection.last_span(iv, spans, width=w).collect())) for w in (None, 4))
    assert whole == blocks


def test_phases_make_their_intervals_once(spark):
    """Made twice, they are sorted twice in the same task; splitting by the phases then held all its sorts in one task."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    d = spark.createDataFrame(ticked([2, 3, 4, 1], ["click", "signup", "", "signup"]), TICKS)
    both = views.with_phases(d.mapInArrow(run, d.schema))
    assert times(both, "phases") == [("g", 0, 2, "phase"), ("g", 2, 9, "phase"), ("g", 9, 10, "phase")] and len(times(both, "a")) == 4
    assert made.value == 4
    got = splitting.split_grids(both, "phases").where("tier_name = 'a'").orderBy("grid_id", "idx").collect()
    assert [(r["grid_id"], r["t0"], r["t1"], r["mark"]) for r in got] == [("g/0", 0, 2, "click"), ("g/1", 0, 3, "signup"), ("g/1", 3, 7, ""), ("g/2", 0, 1, "signup")]


# --- packing


def packed_model(rows, most, pauses):
    chunks = []
    for r in rows:
        inner = [x for x in [*(chunks[-1] if chunks else []), r] if pauses or x[6].strip()]
        content = inner[-1][5] - inner[0][4] if inner else 0
        if chunks and content <= most:
            chunks[-1].append(r)
        else:
            chunks.append([r])
    out = []
    for c in chunks:
        inner = [i for i, r in enumerate(c) if pauses or r[6].strip()]
        lo, hi = (inner[0], inner[-1]) if inner else (len(c), len(c) - 1)
        out += [(r[0], r[4], r[5], r[6]) for r in c[:lo]]
        if inner:
            out.append((c[0][0], c[lo][4], c[hi][5], " ".join(r[6] for r in c[lo : hi + 1] if r[6])))
            out += [(r[0], r[4], r[5], r[6]) for r in c[hi + 1 :]]
    return out


@pytest.mark.parametrize("pauses", [False, True])
@pytest.mark.parametrize("block,width", [(2048, None), (4, 25), (1, None)])
def test_packing_ticks_in_any_blocks(spark, monkeypatch, pauses, block, width):
    monkeypatch.setattr(packing, "BLOCK", block)
    rng = random.Random(block)
    tiers = [ticked([rng.choice([1, 2, 3, 9]) for _ in range(n)], [rng.choice(["", " ", "x", "y", "z"]) for _ in range(n)], f"g{n}") for n in (1, 2, 7, 60)]
    d = spark.createDataFrame([r for t in tiers for r in t], TICKS)
    for most in (1, 5) if block == 2048 else (5,):
        got = times(joining.join_by_duration(d, most, include_pauses=pauses, width=width))
        assert got == [x for t in sorted(tiers) for x in packed_model(t, most, pauses)]
    assert len(times(joining.join_by_duration(d, math.inf, include_pauses=True))) == len(tiers)


def test_packing_a_long_tier(spark):
    """60,000 rows, some thirty blocks, against the fold of the same rows as doubles (whole numbers, so their sums are exact)."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame(ticked(rng.integers(1, 60, 60_000).tolist(), ["x"] * 60_000), TICKS)
    doubles = rows.withColumns({"t0": F.col("t0").cast("double"), "t1": F.col("t1").cast("double")})
    spans = lambda df: sorted((int(r["t0"]), int(r["t1"])) for r in df.select("t0", "t1").collect())
    assert spans(joining.join_by_duration(rows, 500, include_pauses=True, width=300_000)) == spans(joining.join_by_duration(doubles, 500, include_pauses=True))


# --- templates


@pytest.mark.parametrize("block,blocks", [(2048, 1024), (3, 2)])
def test_template_in_any_blocks(spark, monkeypatch, block, blocks):
    monkeypatch.setattr(joining, "BLOCK", block)
    monkeypatch.setattr(joining, "BLOCKS", blocks)
    rng = random.Random(7)
    for template in (["a", "a", "b"], ["a", "b", "a"], ["a"], ["", "b"]):
        marks = [rng.choice(["a", "a", "b", ""]) for _ in range(50)]
        cuts = {0, 50, *rng.sample(range(50), 6)}
        edges = sorted(cuts)
        bounds = [("g", 1, "b", i, a, b, "p") for i, (a, b) in enumerate(zip(edges, edges[1:]))]
        d = spark.createDataFrame(ticked([1] * 50, marks) + bounds, TICKS)
        want, k, chunk = [], 0, []
        for i, m in enumerate(marks):
            if i in cuts:
                want += [[x] for x in chunk]
                k, chunk = 0, []
            if m == template[k]:
                k, chunk = k + 1, [*chunk, i]
            else:
                want += [[x] for x in chunk]
                k, chunk = (1, [i]) if m == template[0] else (0, [])
                want += [] if chunk else [[i]]
            if k == len(template):
                want.append(chunk)
                k, chunk = 0, []
        want += [[x] for x in chunk]
        got = [(a, b) for _, a, b, _ in times(joining.join_template(d, template, "b", ["a"]))]
        assert got == [(c[0], c[-1] + 1) for c in want]


# --- moving boundaries


def snap(edges, t, threshold):
    """One timepoint on the edges as they are: the nearer edge around it moves, if near enough."""
    at = bisect.bisect_left(edges, t)
    if at < len(edges) and edges[at] == t:
        return
    if at == 0:
        if edges[0] - t < threshold:
            edges[0] = t
    elif at == len(edges):
        if t - edges[-1] < threshold:
            edges[-1] = t
    elif t - edges[at - 1] <= edges[at] - t:
        if t - edges[at - 1] <= threshold:
            edges[at - 1] = t
    elif edges[at] - t <= threshold:
        edges[at] = t


@pytest.mark.parametrize("threshold", [2, 5, math.inf])
def test_sweeps_of_islands_equal_one_pass_over_the_tier(spark, threshold):
    rng = random.Random(5)
    rows, want = [], []
    for g in range(40):
        n = rng.randrange(1, 9)
        edges = sorted(rng.sample(range(60), n + 1))
        points = sorted(rng.sample(range(-3, 64), rng.randrange(0, 12)))
        rows += [(f"{g:02d}", 0, "a", i, a, b, str(i)) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
        rows += [(f"{g:02d}", 1, "ref", i, a, b, "") for i, (a, b) in enumerate(zip(points, points[1:]))]
        for t in points if len(points) > 1 else []:
            snap(edges, t, threshold)
        want += [(f"{g:02d}", a, b, str(i)) for i, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
    assert times(alignment.fix_boundaries(spark.createDataFrame(rows, TICKS), "ref", ["a"], threshold)) == want


def test_two_points_near_one_edge():
    edges = [(0.0, 0, False), (1.0, 1, False), (1.1, None, None), (1.2, None, None), (2.0, 2, True)]
    assert list(alignment.sweep(edges, 0.5)) == [(0, 0.0), (1, 1.2), (2, 2.0)]  # the second point moves what the first one moved
    for t, threshold, end in ((1.25, 0.25, 1.0), (1.25, 0.5, 1.25)):  # behind the last edge the distance must be below the threshold
        assert list(alignment.sweep([(0.0, 0, False), (1.0, 1, True), (t, None, None)], threshold)) == [(0, 0.0), (1, end)]


# --- order statistics


@pytest.mark.parametrize("small,parts", [(20_000, 256), (10, 4)])
def test_order_statistics_in_rounds(spark, monkeypatch, small, parts):
    monkeypatch.setattr(orderstats, "SMALL", small)
    monkeypatch.setattr(orderstats, "PARTS", parts)
    rng = random.Random(small)
    groups = {"even": list(range(200)), "ties": [7] * 150 + [9] * 3, "one": [5], None: [rng.randrange(1000) for _ in range(101)], "far": [10**12, *range(60), -(10**12)]}
    rows = spark.createDataFrame([(g, v, "n") for g, vs in groups.items() for v in vs] + [("even", None, "n"), ("none", None, "n")], "g string, v long, n string")
    ranks = [lambda n: F.lit(0), lambda n: F.floor((n - 1) * 0.37), lambda n: n - 1, lambda n: n]
    got = {r["g"]: (r["n"], r["stats"]) for r in orderstats.at_ranks(rows, ["g"], "v", ranks).collect()}
    sorts = {g: sorted(vs) for g, vs in groups.items()}
    assert got == {g: (len(s), [s[0], s[math.floor((len(s) - 1) * 0.37)], s[-1], None]) for g, s in sorts.items()}
    everything = sorted(v for vs in groups.values() for v in vs)
    (whole,) = orderstats.at_ranks(rows.select("v"), [], "v", [lambda n: F.floor(n / 2)]).collect()
    assert (whole["n"], whole["stats"]) == (len(everything), [everything[len(everything) // 2]])
    assert orderstats.at_ranks(rows.where("false"), ["g"], "v", ranks).count() == 0
