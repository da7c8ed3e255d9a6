"""Interval operators on small tiers with known results, and folds against plain models."""

import math
import random
import statistics
import wave

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marklane.model import COLUMNS, is_pause
from marklane.operators import alignment, comparison, creation, dictionary, joining, marks, orderstats, selection, splitting, stats, tiers, validation
from marklane.sources import audio, files, gridfile, tables

SCHEMA = "grid_id string, tier_idx int, tier_name string, idx long, t0 double, t1 double, mark string"


def tier(rows, name="a", tier_idx=0, grid="g"):
    return [(grid, tier_idx, name, i, float(a), float(b), m) for i, (a, b, m) in enumerate(rows)]


def frame(spark, *parts):
    return spark.createDataFrame([r for p in parts for r in p], SCHEMA)


def out(df, name="a"):
    return [(r["t0"], r["t1"], r["mark"]) for r in df.where(F.col("tier_name") == name).orderBy("grid_id", "tier_idx", "idx").collect()]


def units(marks_):
    return [(i, i + 1, m) for i, m in enumerate(marks_)]


def sizes(df):
    return [int(b - a) for a, b, _ in out(df)]


def test_pause_predicate(spark):
    texts = [None, "", " ", " ", "　", "\x1c", "\n\t", "a", " a "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, mark string")
    got = [r[0] for r in rows.orderBy("i").select(is_pause()).collect()]
    assert got == [(t or "").strip() == "" for t in texts]


def test_join_by_duration(spark):
    d = frame(spark, tier(units(["", "a", "b", "", "", "c", "", "d", "", "e", "f", "g", "h", ""])))
    assert [m for _, _, m in out(joining.join_by_duration(d, 3))] == ["", "a b", "", "", "c d", "", "e f g", "h", ""]
    assert [(a, b) for a, b, m in out(joining.join_by_duration(d, 3)) if m == "c d"] == [(5.0, 8.0)]
    assert out(joining.join_by_duration(frame(spark, tier([(0, 2, "e")])), 1)) == [(0.0, 2.0, "e")]
    assert sizes(joining.join_by_duration(d, 3, include_pauses=True)) == [3, 3, 3, 3, 2]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 5), st.sampled_from(["", "x"])), min_size=1, max_size=14), st.integers(1, 8))
def test_packing_against_model(spark, parts, most):
    """The content of a tentative chunk, measured afresh without the pauses at its ends, decides whether it grows."""
    rows, at = [], 0
    for d, m in parts:
        rows.append((at, at + d, m))
        at += d

    def content(chunk):
        inner = [r for r in chunk if r[2]]
        return inner[-1][1] - inner[0][0] if inner else 0

    chunks: list = []
    for r in rows:
        if chunks and content([*chunks[-1], r]) <= most:
            chunks[-1].append(r)
        else:
            chunks.append([r])
    want = []
    for c in chunks:
        inner = [i for i, r in enumerate(c) if r[2]]
        lo, hi = (inner[0], inner[-1]) if inner else (len(c), len(c) - 1)
        want += [(float(a), float(b), m) for a, b, m in c[:lo]]
        if inner:
            want.append((float(c[lo][0]), float(c[hi][1]), " ".join(r[2] for r in c[lo : hi + 1] if r[2])))
        want += [(float(a), float(b), m) for a, b, m in c[hi + 1 :]] if inner else []
    assert out(joining.join_by_duration(frame(spark, tier(rows)), most)) == want


def test_join_between_pauses(spark):
    d = frame(spark, tier(units(["", "text", "", "", "text", "text", ""])))
    assert [len(out(joining.join_between_pauses(d, p))) for p in (0, 1.1, math.inf)] == [6, 4, 1]
    with pytest.raises(ValueError):
        joining.join_between_pauses(d, -1)


def test_merge_keeps_or_drops_empty(spark):
    d = frame(spark, tier(units(["", "b", " ", "c", "d"])))
    assert out(joining.join_all(d, join_with="X", keep_empty=True)) == [(0.0, 5.0, "XbX XcXd")]
    assert out(joining.join_all(d, join_with="X")) == [(0.0, 5.0, "bX XcXd")]


def test_template_with_boundaries(spark):
    a = tier(units(["a", "", "c", "a", "", "x", "y", "b", "a", "a", "", "c", ""]))
    cuts = [0, 3, 4, 6, 7, 8, 11, 12, 13]
    b = tier(list(zip(cuts, cuts[1:], ["p"] * 8)), "b", 1)
    assert sizes(joining.join_template(frame(spark, a, b), ["a", "", "c"], "b", ["a"])) == [3] + [1] * 10
    assert sizes(joining.join_template(frame(spark, tier(units("aaab"))), ["a", "a", "b"])) == [1] * 4


def test_symbols(spark):
    d = frame(spark, tier([(0.5, 1, "a"), (1, 1.5, "X")]))
    assert len(out(joining.join_symbols(d, "right", ["X"]))) == 1 and len(out(joining.join_symbols(d, "left", ["X"]))) == 2
    assert [m for _, _, m in out(joining.join_symbols(frame(spark, tier(units(["X", "a", "X", "X", "", "X"]))), "right", ["X"]))] == ["X", "aXX", "", "X"]
    assert [m for _, _, m in out(joining.join_symbols(frame(spark, tier(units(["X", "a", "X", "X"]))), "together", ["X"]))] == ["X", "a", "XX"]


def test_boundary_tier_without_match_changes_nothing(spark):
    d = frame(spark, tier(units("abcd")), tier([(0, 1.5, "x"), (1.5, 4, "y")], "b", 1))
    assert out(joining.join_by_boundary(d, "b", ["a"])) == [(float(i), i + 1.0, m) for i, m in enumerate("abcd")]
    assert [r["t"] for r in validation.missing_boundaries(d, "b", ["a"]).collect()] == [1.5]
    d = frame(spark, tier(units("abcd")), tier([(0, 2, "x"), (2, 4, "y")], "b", 1))
    assert out(joining.join_by_boundary(d, "b", ["a"])) == [(0.0, 2.0, "a b"), (2.0, 4.0, "c d")]


def test_boundaries_against_brute_force(spark):
    rng, wanted, tiers = random.Random(5), {}, []
    for g in range(40):
        cuts = sorted({0, 12, *rng.sample(range(1, 12), rng.randint(0, 10))})
        some = sorted({0, 12, *rng.sample(cuts, rng.randint(0, len(cuts)))})
        if g % 4 == 0:
            some = sorted({*some, rng.randint(0, 12)})
        if g % 5 == 0:
            some = some[: rng.randint(2, len(some))]  # ends before the tier, or where it ends
        if g % 7 == 0:
            some = [*some, 15]
        spans = [(a, b, rng.choice("xyz")) for a, b in zip(cuts, cuts[1:])]
        tiers.append(tier(spans, grid=f"g{g}"))
        if g != 3:
            tiers.append(tier([(a, b, "p") for a, b in zip(some, some[1:])], "b", 1, grid=f"g{g}"))
        chunks = []
        for a, b, m in spans:
            if g == 3 or a in some or not set(some) <= set(cuts) or not chunks:
                chunks.append((a, b, m))
            else:
                chunks[-1] = (chunks[-1][0], b, f"{chunks[-1][2]} {m}")
        wanted[f"g{g}"] = [(float(a), float(b), m) for a, b, m in chunks]
    got = joining.join_by_boundary(frame(spark, *tiers), "b", ["a"]).where("tier_name = 'a'").orderBy("grid_id", "idx").collect()
    assert {g: [(r["t0"], r["t1"], r["mark"]) for r in got if r["grid_id"] == g] for g in wanted} == wanted


def test_split(spark):
    d = frame(spark, tier([(0, 0.5, ""), (0.5, 2, '"This test"'), (2, 2.5, ""), (2.5, 3, ""), (3, 5, "Is right."), (5, 6, None)]))
    got = out(splitting.split_intervals(d))
    assert len(got) == 8 and got[1] == (0.5, 1.25, '"This') and got[5][:2] == (3.0, 4.0) and got[-1] == (5.0, 6.0, None)
    got = out(splitting.split_intervals(frame(spark, tier([(0.5, 2, "ab")])), "", keep=True))
    assert [m for _, _, m in got] == ["a", "", "b"] and got[0][:2] == (0.5, 1.0)
    thirds = out(splitting.split_intervals(frame(spark, tier([(1, 2, "a|b|c")])), "|"))
    assert [t for t, _, _ in thirds] == [1.0, 1 + 1 / 3, 1 + 2 / 3]


def test_remove_spans(spark):
    a = tier([(0, 3, "A1"), (3, 4, "A2"), (4, 4.5, "A3"), (4.5, 5, "A4"), (5, 6, "A5"), (6, 7, "A6"), (7, 8, "A7"), (8, 9, "A8")])
    b = tier([(0, 1, "B1"), (1, 2, "B2"), (2, 3, "B3"), (3, 4, "B4"), (4, 5, "B5"), (5, 6, "B6"), (6, 9, "B7")], "b", 1)
    spans = spark.createDataFrame([("g", 0.0, 3.0), ("g", 4.0, 5.0), ("g", 6.0, 9.0)], "grid_id string, lo double, hi double")
    got = alignment.remove_spans(frame(spark, a, b), spans)
    assert out(got) == [(0.0, 1.0, "A2"), (1.0, 2.0, "A5")] and out(got, "b") == [(0.0, 1.0, "B4"), (1.0, 2.0, "B6")]
    late = frame(spark, tier([(2, 4, "x"), (4, 4.5, "y"), (4.5, 5, "y"), (5, 6, "z")]))
    assert out(alignment.remove_spans(late, spark.createDataFrame([("g", 4.0, 5.0)], "grid_id string, lo double, hi double"))) == [(2.0, 4.0, "x"), (4.0, 5.0, "z")]
    whole = spark.createDataFrame([("g", 2.0, 6.0)], "grid_id string, lo double, hi double")
    assert len(out(alignment.remove_spans(late, whole))) == 4  # nothing would be left: unchanged


def test_merge_spans(spark):
    spans = [(0, 2.001), (2.001, 4), (4.1, 4.5), (4.6, 4.71), (4.71, 4.72), (4.72, 4.8), (5, 5.1), (5.15, 6), (6, 100.123)]
    d = spark.createDataFrame([("g", float(a), float(b)) for a, b in reversed(spans)], "grid_id string, lo double, hi double")
    assert [(r["lo"], r["hi"]) for r in alignment.merge_spans(d).orderBy("lo").collect()] == [(0, 4), (4.1, 4.5), (4.6, 4.8), (5, 5.1), (5.15, 100.123)]


def test_fix_boundaries(spark):
    d = frame(spark, tier([(0, 1, "x"), (1, 2, "y")]), tier([(0, 1.004, "p"), (1.004, 2, "q")], "ref", 1))
    assert out(alignment.fix_boundaries(d, "ref", ["a"])) == [(0.0, 1.004, "x"), (1.004, 2.0, "y")]


def test_sync_and_merge(spark):
    d = frame(spark, tier([(0.5, 1, "x"), (1, 2, "y")]), tier([(0, 1, "z")], grid="h"))
    sound = spark.createDataFrame([("g", 30_000, 10_000), ("h", 0, 10_000)], "grid_id string, n_samples long, sample_rate int")
    assert out(alignment.sync_to_audio(d, sound)) == [(0.0, 1.0, "x"), (1.0, 3.0, "y"), (0.0, 1.0, "z")]
    assert out(alignment.merge_grids(d, F.lit("all"), separator=(0.25, "sep"))) == [(0.0, 0.5, "x"), (0.5, 1.5, "y"), (1.5, 1.75, "sep"), (1.75, 2.75, "z")]


def test_replace_text_both_ends(spark):
    d = frame(spark, tier(units(["-", "a", "b", "", "a"])), tier(units(["a", "b", "a", "X", "-"]), "c", 1))
    got = marks.replace_text(d, "^(a|-|REPLACED)$", "REPLACED", "both")
    assert [m for _, _, m in out(got)] == ["REPLACED", "REPLACED", "b", "", "REPLACED"]
    assert [m for _, _, m in out(got, "c")] == ["REPLACED", "b", "a", "X", "REPLACED"]


def test_durations(spark):
    four = frame(spark, tier([(0, 1, "m"), (1, 3, "m"), (3, 6, "m"), (6, 10, "m")]))
    assert stats.duration_bounds(four, ["tier_name"], 5, 90, per_mark=False).select("lo", "hi").first()[:] == (1.15, 3.7)
    d = frame(spark, tier([(0, 0.5, "a"), (0.5, 1.5, "b"), (1.5, 2, ""), (2, 3, "a"), (3, 5, "a"), (5, 6, "c")]), tier([(0, 0.5, "-"), (0.5, 1.5, "-"), (1.5, 2, "-"), (2, 3, "-"), (3, 5, "X"), (5, 6, "-")], "b", 1))
    got = stats.select_durations(d, "a", ["a", "c"], ["grid_id"], 40, math.inf, min_count=2)
    assert sorted(r["t0"] for r in got.collect()) == [2.0, 3.0]
    labelled = stats.label_durations(d, "a", "b", "X", ["a", "c"], ["grid_id"], 40, math.inf, min_count=2)
    assert [m for _, _, m in out(labelled, "b")] == ["-", "-", "-", "X", "X", "-"]
    counts = {r["counter"]: r["n"] for r in stats.label_counts(d, "a", "b", "X", ["a", "c"], ["grid_id"], 40, math.inf, min_count=2).collect()}
    assert counts == {"total": 6, "considered": 4, "enough": 3, "matching": 2, "changed": 1}
    five = frame(spark, tier([(0, 0.5, "a"), (0.5, 1.5, "b"), (1.5, 2, ""), (2, 3, "a"), (3, 5, "a")]), tier([(0, 0.5, "-"), (0.5, 1.5, "-"), (1.5, 2, "-"), (2, 3, "-"), (3, 5, "X")], "b", 1))
    counts = {r["counter"]: r["n"] for r in stats.label_counts(five, "a", "b", "X", ["a"], [], 1, math.inf, range_mode="absolute", per_mark=False).collect()}
    assert counts == {"total": 5, "considered": 3, "enough": 3, "matching": 2, "changed": 1}
    assert len(stats.select_durations(d, "a", ["a"], [], 1, math.inf, range_mode="absolute").collect()) == 2


def test_tiers(spark):
    d = frame(spark, tier([(0, 1, "x")]), tier([(0, 1, "y")], "b", 1), tier([(0, 1, "z")], "c", 2))
    names = lambda df: [r["tier_name"] for r in df.orderBy("tier_idx").collect()]
    assert names(tiers.move_tier(d, "c", 1)) == ["c", "a", "b"] and names(tiers.move_tier(d, "a", 3)) == ["b", "c", "a"] and names(tiers.move_tier(d, "a", 4)) == ["a", "b", "c"]
    assert names(tiers.rename_tier(d, "a", "q")) == ["q", "b", "c"] and names(tiers.rename_tier(d, "a", "b")) == ["a", "b", "c"]
    assert names(tiers.clone_tier(d, "b", ["d", "e"])) == ["a", "b", "c", "d", "e"]
    assert names(selection.remove_tiers(d, ["a", "b"])) == ["c"] and names(selection.remove_tiers(d, ["a", "b", "c"])) == ["a", "b", "c"]


def test_dictionary_and_transcription(spark):
    d = frame(spark, tier([(0, 2, "ab"), (2, 3, ""), (3, 5, "ab")]), tier([(0, 1, "A"), (1, 2, "B"), (2, 3, ""), (3, 4, "A"), (4, 5, "B")], "p", 1))
    (row,) = dictionary.pronunciations(d, "a", "p").collect()
    assert (row["word"], row["pronunciation"], row["weight"]) == ("ab", ["A", "B"], 2)
    words = dictionary.pronunciations(d, "a", "p")
    assert out(dictionary.transcribe(d, words, ["a"])) == [(0.0, 1.0, "A"), (1.0, 2.0, "B"), (2.0, 3.0, ""), (3.0, 4.0, "A"), (4.0, 5.0, "B")]
    assert [m for _, _, m in out(dictionary.transcribe(d, words.where("false"), ["a"], "replace", "?"))] == ["?", "", "?"]


def test_creation_and_validation(spark):
    texts = spark.createDataFrame([("g", "x" * 30, 0.5, 1.0), ("h", "", None, None), ("i", "abc", 9.0, None)], "grid_id string, text string, start double, end double")
    assert out(creation.create_grids(texts), "text") == [(0.0, 0.5, ""), (0.5, 1.0, "x" * 30), (1.0, 2.0, "")]
    assert sorted(r["grid_id"] for r in creation.creation_errors(texts).collect()) == ["h", "i"]
    bad = frame(spark, tier([(1, 2, ""), (3, 4, "")]), tier([(1, 2, ""), (2, 3, "")], grid="ok"))
    assert [(r["grid_id"], r["error"]) for r in validation.invalid_grids(bad).collect()] == [("g", "intervals are not consecutive")]
    changed = validation.results(bad, bad.withColumn("mark", F.when(F.col("grid_id") == "ok", "x").otherwise(F.col("mark"))))
    assert {r["grid_id"]: r["changed"] for r in changed.collect()} == {"g": False, "ok": True}
    assert [r["error"] for r in validation.tier_errors(bad, unique=["nope"]).limit(1).collect()] == ["tier does not exist: nope"]


def test_comparison(spark):
    a = frame(spark, tier([(0, 1, "x"), (1, 2, "y")]))
    b = frame(spark, tier([(0, 1.1, "x"), (1.1, 2, "y")]))
    pairs = comparison.paired(a, b, "a")
    rows = {r["name"]: r for r in comparison.boundary_stats(pairs, {"both": ["x", "y"]}, [50]).collect()}
    assert rows["x"]["sum_diff"] == 100 and rows["-ALL-"]["n"] == 2 and rows["both"]["Match(50,inf]ms"] == 2 and rows["y"]["Match0ms"] == 0
    assert comparison.mismatches(comparison.paired(a, b.where("idx = 0"), "a")).first()["n"] == 1


def test_boundary_medians_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i % 3, i, rng.choice("xyz"), "x", float(rng.randint(0, 400)), float(rng.randint(0, 400))) for i in range(301)] + [(9, 0, None, "x", None, 5.0)]
    pairs = spark.createDataFrame(rows, "grid_id long, k long, mark_a string, mark_b string, da double, db double")
    for small in (orderstats.SMALL, 20):  # all at once, and in rounds
        monkeypatch.setattr(orderstats, "SMALL", small)
        got = {(r["name"], r["kind"]): r for r in comparison.boundary_stats(pairs, {"two": ["x", "y", "x"], "none": ["q"]}, [50], to_ms=1.0).collect()}
        held = {("-ALL-", "group"): "xyz", ("two", "group"): "xy", **{(m, "mark"): m for m in "xyz"}}
        assert set(got) == {*held, (None, "mark")}
        for key, names in held.items():
            diffs = [abs(a - b) for _, _, m, _, a, b in rows if m is not None and m in names]
            assert got[key]["median_diff"] == statistics.median(diffs) and got[key]["sum_diff"] == sum(diffs)
        assert got[None, "mark"]["n"] == 1 and got[None, "mark"]["median_diff"] is None and got["-ALL-", "group"]["n"] == 302
    assert comparison.boundary_stats(pairs.where("false")).count() == 0


def test_files_round_trip(spark, tmp_path):
    text = 'say "hi"\nthere'
    d = frame(spark, tier([(0, 0.0001, "a"), (0.0001, 2, text), (2, 3.5, None)]), tier([(0, 3.5, "")], 'b"c', 1))
    texts = {r["grid_id"]: r["text"] for r in gridfile.to_texts(d).collect()}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "g.textgrid").write_text(texts["g"])
    (tmp_path / "bad.TextGrid").write_text("nothing")
    (tmp_path / "short.TextGrid").write_text('File type = "ooTextFile"\nObject class = "TextGrid"\n\n0\n2\n<exists>\n2\n"IntervalTier"\n"w"\n0\n2\n2\n0\n2\n"x"\n2\n2\n"none"\n"TextTier"\n"p"\n0\n2\n1\n1.5\n"here"\n')
    rows = gridfile.read_grids(spark, str(tmp_path))
    back = gridfile.intervals(rows)
    assert [(r["tier_name"], r["t0"], r["t1"], r["mark"]) for r in back.where("grid_id = 'sub/g'").orderBy("tier_idx", "idx").collect()] == [("a", 0.0, 0.0001, "a"), ("a", 0.0001, 2.0, text), ("a", 2.0, 3.5, ""), ('b"c', 0.0, 3.5, "")]
    assert [r["mark"] for r in back.where("grid_id = 'short'").collect()] == ["x"] and gridfile.points(rows).first()["t"] == 1.5
    assert [r["grid_id"] for r in rows.where("error is not null").collect()] == ["bad"]
    assert sorted(r["grid_id"] for r in gridfile.list_files(spark, str(tmp_path)).collect()) == ["bad", "short", "sub/g"]
    gridfile.write_grids(d, str(tmp_path / "out"))
    assert (tmp_path / "out" / "g.TextGrid").read_text() == texts["g"]
    assert gridfile.number(3.0) == "3" and gridfile.number(0.0001) == "0.0001"


def test_audio(spark, tmp_path):
    with wave.open(str(tmp_path / "g.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(100)
        w.writeframes(bytes(range(200)))
    row = audio.read_audio(spark, str(tmp_path), with_content=True).first()
    assert (row["grid_id"], row["sample_rate"], row["n_samples"]) == ("g", 100, 100)
    with wave.open(__import__("io").BytesIO(audio.without(row["content"], [(0.1, 0.5)]))) as w:
        assert w.getnframes() == 60
    spans = spark.createDataFrame([("g", 0.25, 0.5, "g/0")], "grid_id string, lo double, hi double, new_id string")
    assert audio.cut_audio(audio.read_audio(spark, str(tmp_path), True), spans).first()["n_samples"] == 25
    (tmp_path / "words.txt").write_text(";;; note\nab  A B\nab(2)  A\n")
    assert sorted((r["word"], r["pronunciation"]) for r in tables.read_dictionary(spark, str(tmp_path / "words.txt")).collect()) == [("ab", ["A"]), ("ab", ["A", "B"])]


def test_positions(spark):
    d = frame(spark, tier(units(["x", "x", "a", "x"])))
    starts = lambda mode: [int(a) for a, _, _ in out(selection.at_ends(d, ["x"], mode))]
    assert (starts("all"), starts("start"), starts("end"), starts("both")) == ([0, 1, 3], [0, 1], [3], [0, 1, 3])
    assert d.columns == COLUMNS


def test_default_punctuation_is_plain(spark):
    assert len(joining.JOIN_SYMBOLS) == len(set(joining.JOIN_SYMBOLS)) == 62 and not {"^", "_", "|", "·"} & set(joining.JOIN_SYMBOLS)
    d = frame(spark, tier(units(["a", "。", "^", "b", "～"])))
    assert [m for _, _, m in out(joining.join_symbols(d))] == ["a。", "^", "b～"]


def test_merge_aligns_the_other_tiers(spark):
    d = frame(spark, tier([(0, 1, "x"), (1, 2, "y")]), tier([(0, 1.75, "p")], "b", 1), tier([(0, 1, "z")], grid="h"), tier([(0, 1.25, "q")], "b", 1, "h"))
    merged = alignment.merge_grids(d, F.lit("all"))
    assert out(merged) == [(0.0, 1.0, "x"), (1.0, 2.0, "y"), (2.0, 3.0, "z")]
    # 1 moves the nearer 1.75; 2 lies as near to that as to 3 and moves it on
    assert out(merged, "b") == [(0.0, 2.0, "p"), (2.0, 3.0, "q")]
    alone = frame(spark, tier([(2, 3, "x")]), tier([(2, 2.5, "p"), (2.5, 3, "q")], "b", 1))
    assert sorted(alignment.merge_grids(alone, F.lit("g")).collect()) == sorted(alone.collect())


def test_round_times(spark):
    d = frame(spark, tier([(0.125, 2.675, "x")]))
    assert out(alignment.round_times(d, 2)) == [(round(0.125, 2), round(2.675, 2), "x")]


def test_spans_by_running_values(spark):
    """Against a plain search of all spans, with an interval across an edge and one before all spans."""
    d = frame(spark, tier([(0, 1, "a"), (1, 2, "b"), (2, 4, "c"), (4, 5, "d"), (5, 6, "e"), (6, 9, "f")]), tier([(0, 1, "z")], grid="h"))
    spans = [(1.0, 3.0, "s"), (4.0, 6.0, "t")]
    got = selection.within_spans(d, spark.createDataFrame([("g", *x) for x in spans], "grid_id string, lo double, hi double, name string"))
    want = sorted((a, b, n) for a, b, _ in [(0, 1, 0), (1, 2, 0), (2, 4, 0), (4, 5, 0), (5, 6, 0), (6, 9, 0)] for lo, hi, n in spans if lo <= a and b <= hi)
    assert sorted((r["t0"], r["t1"], r["name"]) for r in got.collect()) == want


def test_writing_grids(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "p.TextGrid").write_text('File type = "ooTextFile"\nObject class = "TextGrid"\n\n0\n2\n<exists>\n3\n"TextTier"\n"points"\n0\n2\n1\n1.5\n"here"\n"IntervalTier"\n"none"\n0\n2\n0\n"IntervalTier"\n"w"\n0\n2\n1\n0\n2\n"x"\n')
    rows = gridfile.read_grids(spark, str(source))
    assert [r["outcome"] for r in gridfile.write_grids(rows, str(tmp_path / "dry"), dry=True).collect()] == ["written"] and not (tmp_path / "dry").exists()
    gridfile.write_grids(rows, str(tmp_path / "out"))
    back = gridfile.read_grids(spark, str(tmp_path / "out"))
    kept = sorted((r["tier_name"], r["kind"], r["t0"], r["t1"], r["mark"]) for r in back.collect())
    assert kept == [("none", "interval", 0.0, 2.0, ""), ("points", "point", 1.5, 1.5, "here"), ("w", "interval", 0.0, 2.0, "x")]
    d = frame(spark, tier([(0, 1, "x")], grid="p"), tier([(0, 1, "x"), (2, 3, "y")], grid="gap"), tier([(0, 1, "é")], grid="new"))
    got = {r["grid_id"]: r["outcome"] for r in gridfile.write_grids(d, str(tmp_path / "out"), overwrite=False, encoding="utf-16").collect()}
    assert got == {"p": "exists", "gap": "invalid", "new": "written"}
    assert 'text = "é"' in (tmp_path / "out" / "new.TextGrid").read_text("utf-16") and not (tmp_path / "out" / "gap.TextGrid").exists()
    same = {r["grid_id"]: r["outcome"] for r in gridfile.write_grids(d.where("grid_id = 'p'"), str(tmp_path / "copy"), changed=spark.createDataFrame([], "grid_id string"), unchanged_from=str(source)).collect()}
    assert same == {"p": "copied"} and (tmp_path / "copy" / "p.TextGrid").read_bytes() == (source / "p.TextGrid").read_bytes()
    assert not [f for f in (tmp_path / "out").iterdir() if f.suffix != ".TextGrid"]


def test_small_files_share_batches_and_large_ones_do_not(spark, monkeypatch):
    short = lambda n: ('File type = "ooTextFile"\nObject class = "TextGrid"\n\n0\n9\n<exists>\n1\n"TextTier"\n"p"\n0\n9\n%d\n' % n + "".join(f'{i / n}\n"é{i}"\n' for i in range(n))).encode()
    files = [("a", short(3)), ("bad", b"nothing"), ("b", short(2)), ("none", short(0)), ("utf", b"\xff"), ("large", short(50)), ("c", short(1))]
    alone = [r for f in files for b in gridfile.rows_of([f], "utf-8") for r in b.to_pylist()]
    assert [r["grid_id"] for r in alone] == [*"aaa", "bad", *"bb", "none", "utf", *["large"] * 50, "c"] and [r["grid_id"] for r in alone if r["error"]] == ["bad", "utf"]
    for rows, size, want in ((10_000, 1 << 20, [59]), (10_000, 400, [8, 50, 1]), (4, 1 << 20, [4, 4, 50, 1]), (1, 1, [3, 1, 2, 1, 1, 50, 1])):
        monkeypatch.setattr(gridfile, "BATCH_ROWS", rows)
        monkeypatch.setattr(gridfile, "BATCH_BYTES", size)
        batches = list(gridfile.rows_of(iter(files), "utf-8"))
        assert [b.num_rows for b in batches] == want and [r for b in batches for r in b.to_pylist()] == alone
    monkeypatch.undo()
    assert [r["t0"] for b in gridfile.rows_of(files, "utf-8", {"p"}) for r in b.to_pylist() if r["grid_id"] == "b"] == [0.0, 0.5] and not list(gridfile.rows_of(files, "utf-8", {"q"}))


def test_tasks_take_many_small_files(spark, tmp_path, monkeypatch):
    for k in range(40):
        (tmp_path / f"{k}.TextGrid").write_text(f'File type = "ooTextFile"\nObject class = "TextGrid"\n\n0\n1\n<exists>\n1\n"TextTier"\n"p"\n0\n1\n1\n0.5\n"{k}"\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a file a task
    try:
        for cores, want in ((4, 16), (0, 5)):
            monkeypatch.setattr(gridfile, "TASKS_PER_CORE", cores)
            rows = gridfile.read_grids(spark, str(tmp_path))
            assert rows.rdd.getNumPartitions() == want and sorted(int(r["mark"]) for r in rows.collect()) == list(range(40))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "empty").mkdir()
    assert gridfile.read_grids(spark, str(tmp_path / "empty")).count() == 0


def test_writing_makes_its_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    d = frame(spark, tier([(0, 1, "x"), (1, 2, "y")], grid="p"), tier([(0, 1, "z")], grid="q"))
    gridfile.write_grids(d.mapInArrow(run, d.schema), str(tmp_path / "out"))
    assert made.value == 3 and {r["mark"] for r in gridfile.read_grids(spark, str(tmp_path / "out")).collect()} == set("xyz")


def test_copy_files_all_or_none(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    (tmp_path / "list.txt").write_text(f"{tmp_path}/b\n{tmp_path}/a\n\n{tmp_path}/b\n")
    paths = tables.read_paths(spark, str(tmp_path / "list.txt"))
    assert [r["path"] for r in paths.where("path is not null").orderBy("position").collect()] == [f"{tmp_path}/b", f"{tmp_path}/a"]
    named = paths.where("path is not null").select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    with pytest.raises(ValueError):
        files.copy_files(named, str(tmp_path / "to"))
    assert not (tmp_path / "to").exists()
    (tmp_path / "b").write_text("2")
    files.copy_files(named, str(tmp_path / "to"))
    assert (tmp_path / "to" / "b").read_text() == "2"


def test_audio_loses_the_same_spans(spark, tmp_path):
    with wave.open(str(tmp_path / "g.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(10)
        w.writeframes(bytes(range(100)))
    d = frame(spark, tier([(0, 2, "x"), (2, 5, ""), (5, 10, "y")]))
    spans = alignment.usable_spans(d, alignment.spans_with_marks(d, "a", [""]))
    cut = audio.remove_from_audio(audio.read_audio(spark, str(tmp_path), True), spans)
    assert cut.first()["n_samples"] == 70
    assert validation.audio_mismatches(alignment.remove_spans(d, spans.select("grid_id", "lo", "hi")), cut).count() == 0
    audio.write_audio(cut, str(tmp_path / "out"))
    with wave.open(str(tmp_path / "out" / "g.wav")) as w:
        assert w.readframes(100) == bytes([*range(20), *range(50, 100)])
    # an edge that is no boundary: neither side is cut
    odd = alignment.usable_spans(d, spark.createDataFrame([("g", 1.0, 2.0)], "grid_id string, lo double, hi double"))
    assert audio.remove_from_audio(audio.read_audio(spark, str(tmp_path), True), odd).where("grid_id = 'g'").first()["n_samples"] == 100
