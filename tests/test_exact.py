"""Rounding, regular expressions, ranged audio, path lists, the data source and incremental runs, against Python's own results."""

import functools
import io
import math
import random
import re
import shutil
import struct
import wave

import pytest
from pyspark.sql import functions as F

from marklane.operators import regex, rounding, selection
from marklane.plans import catalog
from marklane.sources import audio, datasource, gridfile, incremental, tables

from .test_operators import frame, out, tier, units


def test_rounding_equals_python(spark):
    rng = random.Random(11)
    values = [0.0, -0.0, 0.5, 1.5, 2.5, -2.5, 2.675, 0.00005, 1e300, -1e-300, 5e-324, 1.7976931348623157e308, 2.0**53 + 2, 0.1, 1e15 + 0.5, 4503599627370495.5, 0.125, 0.375, 2.0**-68, 2.0**-53]
    values += [rng.uniform(-1, 1) * 10 ** rng.uniform(-25, 20) for _ in range(60_000)] + [rng.randrange(-(10**9), 10**9) / 10 ** rng.randrange(1, 9) for _ in range(40_000)] + [rng.randrange(10**6) / 2 ** rng.randrange(1, 20) for _ in range(20_000)]
    digits = (0, 2, 4, 9, 15)
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[rounding.exact_round(F.col("v"), d).alias(f"d{d}") for d in digits])
    for r in df.collect():
        for d in digits:
            assert struct.pack("d", r[f"d{d}"]) == struct.pack("d", round(r["v"], d) if d else float(round(r["v"], 0))), (r["v"], d)
    odd = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,)], "v double").select(rounding.exact_round(F.col("v"), 2)).collect()
    assert odd[0][0] is None and math.isnan(odd[1][0]) and odd[2][0] == math.inf and odd[3][0] == -math.inf
    with pytest.raises(ValueError):
        rounding.exact_round(F.lit(1.0), 16)


TEXTS = ["", "a", "ab", "aB c", "a\nb", "a\n", "\n", "a\r", "x1y22", "é_٣", "a.b", "$1\\2", "aaa", "abab", "  tab\t", " ", "a\u0085", "word-word", "日本 12", "😀a", "cv", "vc", "ac\nvd\n", "\x1c", "aa bb aa"]
PATTERNS = [
    "a", "^a", "a$", "^$", ".", "a.b", r"\d+", r"\D", r"\w+", r"\W", r"\s", r"\S+", r"\ba", r"a\b", r"\Bb", "[a-c]+", "[^a-c]", r"[^\d\s]", r"[\w-]+", "a|b", "(a)(b)?", "(ab)+", "a{2,3}", "a+?", "(?:x|y)\\d", r"(a)\1", "(?=b)", "(?<=a)b", "(?<!a)b",
    r"\Aa", r"b\Z", "(?m)^v", "(?m)c$", "(?s)a.b", r"[.\]$]", "(?P<q>a)(?P=q)", r"\$", "(?>a+)b", "a++", "[a\\d]", "(c|v)(.)",
    "(?i)A", "(a*)*", "(?a)\\w", "(a)?(?(1)b|c)", "(?i:a)b", "x*",
]


def test_patterns_of_both_engines(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert [p for p in PATTERNS if regex.java_pattern(p) is None] == ["(?i)A", "(a*)*", "(?a)\\w", "(a)?(?(1)b|c)", "(?i:a)b"]
    got = df.select("t", *[regex.found(p)(F.col("t")).alias(f"p{i}") for i, p in enumerate(PATTERNS)]).collect()
    assert [[(r["t"], p) for i, p in enumerate(PATTERNS) if r[f"p{i}"] != (re.search(p, r["t"]) is not None)] for r in got] == [[]] * len(TEXTS)
    swaps = [(p, rep) for p in PATTERNS for rep in ("<>", r"[\g<0>]", "$0\\\\", r"\1x" if re.compile(p).groups else "1")]
    got = df.select("t", *[regex.substituted(p, rep)(F.col("t")).alias(f"p{i}") for i, (p, rep) in enumerate(swaps)]).collect()
    assert [(r["t"], p, rep) for r in got for i, (p, rep) in enumerate(swaps) if r[f"p{i}"] != re.sub(p, rep, r["t"])] == []


def test_literals_equal_python(spark):
    texts = [*TEXTS, "it's", 'say "hi"', """it's "both\\" """, "a\\b", "\x00\x7f\xa0\xad", "\u200b\u2028\u3000", "\U000e0001\U0001f600\U0010ffff", "\r\n\t\x0b", "x" * 5000 + "\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", regex.literal(F.col("t")).alias("r")).collect()
    assert [(r["t"], r["r"]) for r in got if r["r"] != repr(r["t"])[1:-1]] == []


def test_common_patterns_need_no_workers(spark):
    d = frame(spark, tier(units(["ab", "cd"])))
    plan = selection.matching(d, r"^[a-c]\w+$", "both")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and [m for _, _, m in out(selection.matching(d, "(?i)^AB"))] == ["ab"]


class Counting(io.BytesIO):
    seen = 0

    def read(self, n=-1):
        raw = super().read(n)
        self.seen += len(raw)
        return raw


def test_headers_of_long_and_odd_files(spark, tmp_path):
    with open(tmp_path / "long.wav", "wb") as f:  # a gigabyte of samples that the disk does not hold
        f.write(struct.pack("<4sI4s4sI16s4sI", b"RIFF", 0xFFFFFFF0, b"WAVE", b"fmt ", 16, struct.pack("<HHIIHH", 1, 2, 16000, 64000, 4, 16), b"data", 1 << 30))
        f.truncate((1 << 30) + 44)
    (tmp_path / "foreign.wav").write_bytes(b"RIFFxxxxWAVEjunk")
    (tmp_path / "none.WAV").write_bytes(b"RI")
    extra = struct.pack("<4sI5sx", b"LIST", 5, b"hello") + struct.pack("<4sI16s", b"fmt ", 16, struct.pack("<HHIIHH", 1, 1, 8000, 8000, 1, 8))
    (tmp_path / "chunks.wav").write_bytes(struct.pack("<4sI4s", b"RIFF", 4, b"WAVE") + extra + struct.pack("<4sI", b"data", 3) + b"abc\0")
    large = struct.pack("<4sIQQQI", b"ds64", 28, 0, 4, 4, 0) + struct.pack("<4sI16s", b"fmt ", 16, struct.pack("<HHIIHH", 1, 1, 8000, 8000, 1, 8))
    (tmp_path / "rf64.wav").write_bytes(struct.pack("<4sI4s", b"RF64", 0xFFFFFFFF, b"WAVE") + large + struct.pack("<4sI", b"data", 0xFFFFFFFF) + b"abcdXX")
    got = {r["grid_id"]: (r["sample_rate"], r["n_samples"]) for r in audio.locate_audio(spark, str(tmp_path)).collect()}
    assert got == {"long": (16000, 1 << 28), "foreign": (None, None), "none": (None, None), "chunks": (8000, 3), "rf64": (8000, 4)}
    f = Counting((tmp_path / "chunks.wav").read_bytes() + bytes(1 << 20))
    audio.header_of(f)
    assert f.seen < 100
    spans = spark.createDataFrame([("long", 10.0, 10.5, "part")], "grid_id string, lo double, hi double, new_id string")
    assert audio.cut_audio(audio.locate_audio(spark, str(tmp_path)), spans).select("n_samples", F.length("content")).first()[:] == (8000, 32_044)


def test_ranges_equal_whole_files(spark, tmp_path):
    with wave.open(str(tmp_path / "g.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(1), w.setframerate(10)
        w.writeframes(bytes(range(200)))
    places = audio.locate_audio(spark, str(tmp_path))
    whole = audio.read_audio(spark, str(tmp_path), with_content=True)
    spans = spark.createDataFrame([("g", 1.0, 2.0), ("g", 5.0, 20.0)], "grid_id string, lo double, hi double")
    want = audio.remove_from_audio(whole, spans).first()
    assert audio.save_without(places, spans, str(tmp_path / "cut")).first()[:] == ("g.wav", want["n_samples"]) and want["n_samples"] == 40
    assert (tmp_path / "cut" / "g.wav").read_bytes() == bytes(want["content"])
    named = spans.withColumn("new_id", F.concat("grid_id", F.col("lo").cast("string")))
    a, b = (sorted((r["grid_id"], bytes(r["content"])) for r in audio.cut_audio(x, named).collect()) for x in (places, whole))
    assert a == b


def test_import_keeps_order_and_stops_at_the_first_bad_path(spark, tmp_path):
    source = tmp_path / "in"
    for name in ("b/x.TextGrid", "a/x.TextGrid", "a/y.TextGrid"):
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_text(name)
    names = [f"{source}/{n}" for n in ("b/x.TextGrid", "a/y.TextGrid", "b/x.TextGrid", "a/x.TextGrid")]
    (tmp_path / "list").write_text("\n".join(names) + "\n")
    done = tables.import_files(spark, str(tmp_path / "list"), str(tmp_path / "rel"), str(source)).orderBy("position").collect()
    assert [r["name"] for r in done] == ["b/x.TextGrid", "a/y.TextGrid", "a/x.TextGrid"] and (tmp_path / "rel/b/x.TextGrid").read_text() == "b/x.TextGrid"
    flat = tables.import_files(spark, str(tmp_path / "list"), str(tmp_path / "flat")).count()
    assert flat == 3 and (tmp_path / "flat/x.TextGrid").read_text() == "a/x.TextGrid"  # of one name the last stays
    for bad in ([names[0], f"{source}/z", f"{source}/a"], [names[0], "", f"{source}/z"]):
        (tmp_path / "bad").write_text("\n".join(bad) + "\n")
        with pytest.raises(ValueError, match="z" if bad[1] else "None"):
            tables.import_files(spark, str(tmp_path / "bad"), str(tmp_path / "never"))
    with pytest.raises(ValueError):
        tables.import_files(spark, str(tmp_path / "list"), str(tmp_path / "never"), "/elsewhere")
    assert not (tmp_path / "never").exists()


def test_dictionary_file(spark, tmp_path):
    rows = [("b", ["x", "y"], 2), ("a", ["z"], 1), ("a", ["y"], 7), ("é", ["q"], 10**10)]
    tables.write_dictionary(spark.createDataFrame(rows, "word string, pronunciation array<string>, weight long"), str(tmp_path / "d"))
    assert sorted(tuple(r) for r in tables.read_dictionary(spark, str(tmp_path / "d"), weights=True).collect()) == sorted(rows)
    assert spark.read.text(str(tmp_path / "d")).first()[0] == "a  7  y"


def test_data_source_plans_by_size_and_filters(spark, tmp_path):
    d = frame(spark, *[tier(units("xyz"), grid=f"s/{i:02d}") for i in range(12)], *[tier(units("pq"), "b", 1, f"s/{i:02d}") for i in range(12)])
    datasource.save(d, str(tmp_path / "o"))
    size = (tmp_path / "o/s/00.TextGrid").stat().st_size
    load = lambda **o: spark.read.format("annotations").options(**o).load(str(tmp_path / "o"))
    assert load(partitionBytes=3 * size).rdd.getNumPartitions() == 4 and load(partitionBytes=1).rdd.getNumPartitions() == 12 and load().count() == 72  # the shorter tier is filled up to the grid's end
    some = load(partitionBytes=1).where("grid_id in ('s/03', 's/04', 'none') and tier_name = 'b'")
    assert some.rdd.getNumPartitions() == 2 and sorted({(r["grid_id"], r["mark"]) for r in some.collect()}) == [("s/03", ""), ("s/03", "p"), ("s/03", "q"), ("s/04", ""), ("s/04", "p"), ("s/04", "q")]
    assert load(partitionBytes=1).where("grid_id like 's/1%'").rdd.getNumPartitions() == 2
    assert load().where("grid_id = 's/03' and grid_id = 's/04'").count() == 0
    d.where("grid_id = 's/01'").transform(gridfile.in_files).write.format("annotations").mode("overwrite").save(str(tmp_path / "o"))
    assert sorted(p.name for p in (tmp_path / "o/s").iterdir()) == ["01.TextGrid"] and not [p for p in (tmp_path / "o").iterdir() if p.name.startswith("_")]
    assert load().where("false").count() == 0 and datasource.load(spark, str(tmp_path / "absent")).count() == 0


def test_data_source_takes_back_what_failed(spark, tmp_path):
    """A task that fails ends the job; files of tasks that were done go again, and nothing staged stays."""
    d = frame(spark, *[tier(units("xy"), grid=f"g{i}") for i in range(20)])

    def broken(batches):
        for b in batches:
            if "g7" in b.column(0).to_pylist():
                raise RuntimeError("lost")
            yield b

    spark.range(1).count()
    rows = gridfile.in_files(d)
    datasource.register(spark)
    with pytest.raises(Exception, match="lost"):
        rows.mapInArrow(broken, rows.schema).write.format("annotations").mode("append").save(str(tmp_path / "o"))
    assert not (tmp_path / "o").exists() or not [p for p in (tmp_path / "o").rglob("*.TextGrid")]


def test_incremental_runs_equal_one_run(spark, tmp_path):
    d = frame(spark, *[tier(units("xyx"), grid=f"g{i}") for i in range(9)])
    op = lambda iv: iv.withColumn("mark", F.upper("mark"))
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    datasource.save(d.where("grid_id < 'g4'"), source)
    first = incremental.run_new(spark, source, target, log, op, files_per_batch=3)
    assert {r["outcome"] for r in first.collect()} == {"written"} and first.count() == 4 and first.select("batch").distinct().count() == 2
    datasource.save(d.where("grid_id >= 'g4'"), source)
    (tmp_path / "in" / "bad.TextGrid").write_text("nothing")
    last = incremental.run_new(spark, source, target, log, op)
    assert sorted((r["grid_id"], r["outcome"]) for r in last.collect()) == sorted([(f"g{i}", "written") for i in range(9)] + [("bad", "unreadable")])
    everything = sorted(map(str, datasource.load(spark, target).drop("error").collect()))
    # a batch that broke off: no commit, half of its files, no outcomes
    number = max(int(p.name) for p in (tmp_path / "log/commits/commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "log/commits/commits").iterdir():
        if p.name.strip(".crc") == str(number):
            p.unlink()
    shutil.rmtree(tmp_path / f"log/outcomes/batch={number}")
    (tmp_path / "out/g5.TextGrid").unlink()
    again = incremental.run_new(spark, source, target, log, op)
    assert again.count() == 10 and sorted(map(str, datasource.load(spark, target).drop("error").collect())) == everything
    assert incremental.run_new(spark, source, target, log, op).count() == 10  # nothing new


def test_arrivals_of_several_batches(spark, monkeypatch):
    monkeypatch.setattr(incremental, "run_new", functools.partial(incremental.run_new, files_per_batch=4))
    rows = catalog.QUERIES["s12_incremental"](spark, "/root/testdata/sf0.001").collect()
    assert rows and [(r["grid_id"], r["arrival"]) for r in rows if r["arrival"] != int(r["grid_id"]) % 2] == []


def test_contents_are_read_with_their_headers(spark, tmp_path):
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    audio.write_audio(spark.createDataFrame([("a", audio.without(_recording(50), [])), ("b/c", audio.sliced(_recording(50), 1.0, 2.0))], "grid_id string, content binary"), str(tmp_path))
    found = audio.read_audio(spark, str(tmp_path), with_content=True)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {r["grid_id"]: (r["sample_rate"], r["n_samples"], bytes(r["content"])) for r in found.collect()}
    assert rows == {"a": (10, 50, _recording(50)), "b/c": (10, 10, audio.sliced(_recording(50), 1.0, 2.0)), "bad": (None, None, b"nothing")}


def _recording(n):
    """A WAV file of ``n`` samples of one byte, ten a second."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, 10, n, "NONE", ""))
        w.writeframes(bytes(range(n)))
    return out.getvalue()
