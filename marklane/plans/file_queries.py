"""Queries of the sources and sinks: tables become files, in the tasks, and are read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import shared_folder, written
from ..operators import dictionary, marks, stats
from ..sources import audio, datasource, files, gridfile, incremental, tables
from . import views
from .registry import query
from .views import SQL_EVENTS, SQL_PHASES


@query("s1_files_round_trip", "SELECT CAST(conv_id AS VARCHAR) AS grid_id, n AS tier_name, turn AS idx, turn::DOUBLE AS t0, turn + 1.0::DOUBLE AS t1, coalesce(CASE n WHEN 'text' THEN text ELSE role END, '') AS mark FROM conversations, (VALUES ('text'), ('role')) v(n)")
def s1(spark, sf):
    """Every conversation as a file, written inside the tasks and read back."""
    folder = shared_folder(spark)
    gridfile.write_grids(views.conversations(spark, sf), folder)
    return gridfile.intervals(gridfile.read_grids(spark, folder)).drop("tier_idx")


@query("s2_data_source", "SELECT CAST(conv_id AS VARCHAR) AS grid_id, turn AS idx, turn::DOUBLE AS t0, turn + 1.0::DOUBLE AS t1, coalesce(role, '') AS mark FROM conversations")
def s2(spark, sf):
    """Written and read as a data source; the filter on the tier's name reaches the parser."""
    folder = shared_folder(spark)
    datasource.save(views.conversations(spark, sf), folder)
    return datasource.load(spark, folder).where("tier_name = 'role'").select("grid_id", "idx", "t0", "t1", "mark")


def _short_files(spark: SparkSession, sf: str) -> DataFrame:
    """(name, content): conversations in the short layout, UTF-16, with intervals that do not last, a point tier and quarters of seconds."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    t = lambda c: (F.col("turn") / 4 + c).cast("string")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    spans = F.concat_ws("\n", t(0.0), t(0.25), quoted(F.col("text")), t(0.25), t(0.25), F.lit('"none"'))
    each = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), _joined(spans).alias("spans"), _joined(F.concat_ws("\n", t(0.125), quoted(F.col("role")))).alias("points"))
    size = (F.col("n") / 4).cast("string")
    head = F.concat_ws("\n", F.lit('File type = "ooTextFile short"\n"TextGrid"\n\n0'), size, F.lit("<exists>\n2"))
    spans = F.concat_ws("\n", F.lit('"IntervalTier"\n"text"\n0'), size, (F.col("n") * 2).cast("string"), "spans")
    points = F.concat_ws("\n", F.lit('"TextTier"\n"roles"\n0'), size, F.col("n").cast("string"), "points")
    return each.select(F.concat(F.col("conv_id").cast("string"), F.lit(".TextGrid")).alias("name"), F.encode(F.concat_ws("\n", head, spans, points, F.lit("")), "UTF-16").alias("content"))


def _joined(text: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("x")))), lambda r: r["x"]), "\n")


_SHORT = "SELECT CAST(conv_id AS VARCHAR) AS grid_id, 'text' AS tier_name, 'interval' AS kind, turn AS idx, turn / 4.0::DOUBLE AS t0, (turn + 1) / 4.0::DOUBLE AS t1, coalesce(text, '') AS mark FROM conversations UNION ALL SELECT CAST(conv_id AS VARCHAR), 'roles', 'point', turn, turn / 4.0::DOUBLE + 0.125, turn / 4.0::DOUBLE + 0.125, coalesce(role, '') FROM conversations"


@query("s3_short_format", _SHORT)
def s3(spark, sf):
    """The short layout: encoding, doubled quotes, points, and intervals that do not last left out."""
    folder = shared_folder(spark)
    files.write_files(_short_files(spark, sf), folder)
    return gridfile.read_grids(spark, folder, "utf-16").where("error is null").select("grid_id", "tier_name", "kind", "idx", "t0", "t1", "mark")


@query("s8_points_and_fractions", _SHORT)
def s8(spark, sf):
    """The same files written anew in the long layout, points and fractions of seconds kept."""
    first, second = shared_folder(spark), shared_folder(spark)
    files.write_files(_short_files(spark, sf), first)
    gridfile.write_grids(gridfile.read_grids(spark, first, "utf-16"), second)
    return gridfile.read_grids(spark, second).where("error is null").select("grid_id", "tier_name", "kind", "idx", "t0", "t1", "mark")


_OUTCOME = """
WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
o AS (SELECT CAST(conv_id AS VARCHAR) AS grid_id, conv_id % 4 AS k, CASE WHEN conv_id % 4 = 1 AND n > 2 THEN 'invalid' WHEN conv_id % 4 = 0 THEN 'exists' WHEN conv_id % 2 = 1 THEN 'copied' ELSE 'written' END AS outcome FROM c)
SELECT grid_id, dry, outcome, CASE WHEN outcome = 'invalid' THEN 'intervals are not consecutive' END AS error, NOT dry AND outcome <> 'invalid' OR outcome = 'exists' AS there FROM o, (VALUES (FALSE), (TRUE)) d(dry)"""


@query("s10_save_outcomes", _OUTCOME)
def s10(spark, sf):
    """Files that are there stay, invalid grids are not written, unchanged ones are copied; first as a dry run."""
    rows = views.conversations(spark, sf)
    source, target = shared_folder(spark), shared_folder(spark)
    datasource.save(rows, source)
    datasource.save(rows.where("grid_id % 4 = 0"), target)
    broken = rows.where("grid_id % 4 <> 1 or idx <> 1")
    changed = rows.where("grid_id % 2 = 0").select("grid_id")
    out = []
    for dry in (True, False):
        plan = gridfile.write_grids(broken, target, changed=changed, overwrite=False, dry=dry, unchanged_from=source)
        there = spark.createDataFrame([], "grid_id string") if dry else gridfile.list_files(spark, target)
        seen = F.col("outcome").isin("exists") if dry else F.col("_there").isNotNull()
        joined = plan.join(there.select("grid_id", F.lit(True).alias("_there")), "grid_id", "left")
        out.append(joined.select("grid_id", F.lit(dry).alias("dry"), "outcome", "error", seen.alias("there")))
    return out[0].unionByName(out[1])


@query("s12_incremental", "SELECT CAST(conv_id AS VARCHAR) AS grid_id, turn AS idx, '<' || coalesce(text, '') || '>' AS mark, conv_id % 2 AS arrival FROM conversations")
def s12_incremental(spark, sf):
    """Two arrivals of files, each taken up by a run of its own; the second run leaves the first one's files alone."""
    rows = views.conversations(spark, sf)
    source, target, log = shared_folder(spark), shared_folder(spark), shared_folder(spark)
    op = lambda iv: iv.withColumn("mark", F.concat(F.lit("<"), "mark", F.lit(">")))
    ends = []
    for k in (0, 1):
        datasource.save(rows.where(F.col("grid_id") % 2 == k), source)
        seen = incremental.run_new(spark, source, target, log, op)
        ends.append(seen.agg(F.max("batch")).first()[0])  # a run has as many batches as its files need
    first = seen.select("grid_id", F.when(F.col("batch") <= ends[0], 0).otherwise(1).cast("long").alias("arrival"))
    return datasource.load(spark, target).where("tier_name = 'text'").join(first, "grid_id").select("grid_id", "idx", "mark", "arrival")


@query("s12_file_sets", "SELECT CAST(user_id AS VARCHAR) AS grid_id, CASE WHEN max(conv_id) IS NULL THEN 'first' WHEN max(e) IS NULL THEN 'second' ELSE 'both' END AS found FROM (SELECT user_id, 1 AS e FROM events) FULL JOIN (SELECT conv_id, conv_id AS user_id FROM conversations) USING (user_id) GROUP BY user_id")
def s12(spark, sf):
    """Which ids two folders share (J12): one has a file for each user, the other one for each conversation."""
    a, b = shared_folder(spark), shared_folder(spark)
    users = spark.read.parquet(f"{sf}/events.parquet").select(F.concat(F.col("user_id").cast("string"), F.lit(".TextGrid")).alias("name")).distinct()
    files.write_files(users.withColumn("content", F.encode(F.lit("x"), "UTF-8")), a)
    datasource.save(views.conversations(spark, sf), b)
    return tables.file_sets(gridfile.list_files(spark, a), gridfile.list_files(spark, b))


def _wav(n: Column, rate: int) -> Column:
    """A WAV file of ``n`` samples of one byte, all of them its number modulo 256."""
    little = lambda c: F.concat(*[F.lpad(F.hex(F.shiftright(c, 8 * i).bitwiseAND(F.lit(255))), 2, F.lit("0")) for i in range(4)])
    head = F.concat(F.lit("52494646"), little(n + 36), F.lit("57415645666D74201000000001000100"), little(F.lit(rate)), little(F.lit(rate)), F.lit("0100080064617461"), little(n))
    samples = F.expr("array_join(transform(sequence(0, n - 1), i -> lpad(hex(i % 256), 2, '0')), '')")
    return F.unhex(F.concat(head, samples, F.when(n % 2 == 1, "00").otherwise("")))


def _recordings(spark: SparkSession, sf: str) -> str:
    """A folder with a recording for each user: as many samples as it has events, ten a second."""
    folder = shared_folder(spark)
    n = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("user_id").alias("grid_id")).agg(F.count(F.lit(1)).alias("n"))
    audio.write_audio(n.select("grid_id", _wav(F.col("n"), 10).alias("content")), folder)
    return folder


@query("s14_audio_lengths", "SELECT CAST(user_id AS VARCHAR) AS grid_id, 10 AS sample_rate, count(*) AS n_samples, count(*) / 10.0::DOUBLE AS duration FROM events GROUP BY user_id")
def s14(spark, sf):
    """Lengths from the headers alone."""
    found = audio.locate_audio(spark, _recordings(spark, sf))
    return found.select("grid_id", "sample_rate", "n_samples", (F.col("n_samples") / F.col("sample_rate")).alias("duration"))





@query("x7_audio_slices", f"""WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), k AS (SELECT user_id, n, unnest(range(CAST(ceil(n / 40.0::DOUBLE) AS BIGINT))) AS k FROM e)
SELECT user_id || '/' || k AS grid_id, least(n - 40 * k, 40) AS n_samples, lower(array_to_string(list_transform(range(40 * k, least(40 * k + 40, n)), lambda i: printf('%02x', i % 256)), '')) AS samples FROM k""")
def x7_audio(spark, sf):
    """Slices of four seconds; only their bytes are read."""
    places = written(audio.locate_audio(spark, _recordings(spark, sf)))  # used twice: the headers are read once
    spans = places.select("grid_id", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_samples") / 40).cast("int") - 1)).alias("k"))
    spans = spans.select("grid_id", (F.col("k") * 4.0).alias("lo"), (F.col("k") * 4.0 + 4.0).alias("hi"), F.concat_ws("/", "grid_id", F.col("k").cast("string")).alias("new_id"))
    cut = audio.cut_audio(places, spans)
    return cut.select("grid_id", "n_samples", F.lower(F.hex(F.expr("substring(content, 45, n_samples)"))).alias("samples"))


@query("b4_audio_deletion", "WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT CAST(user_id AS VARCHAR) AS grid_id, n - greatest(0, least(n, 50) - 20) AS n_samples, array_to_string(list_transform(list_filter(range(n), lambda i: i < 20 OR i >= 50), lambda i: printf('%02x', i % 256)), '') AS samples FROM e")
def b4(spark, sf):
    """Seconds 2 to 5 cut out of every recording, from file to file."""
    places = written(audio.locate_audio(spark, _recordings(spark, sf)))  # used twice: the headers are read once
    target = shared_folder(spark)
    audio.save_without(places, places.select("grid_id", F.lit(2.0).alias("lo"), F.lit(5.0).alias("hi")), target)
    back = audio.read_audio(spark, target, with_content=True)
    return back.select("grid_id", "n_samples", F.lower(F.hex(F.expr("substring(content, 45, n_samples)"))).alias("samples"))


@query("s16_paths", "SELECT DISTINCT conv_id || '.TextGrid' AS below FROM conversations")
def s16(spark, sf):
    folder = shared_folder(spark)
    datasource.save(views.conversations(spark, sf), folder)
    return gridfile.list_files(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("below"))


@query("s17_import_paths", "SELECT 'copy/' || conv_id AS grid_id, turn AS idx, coalesce(text, '') AS mark FROM conversations")
def s17(spark, sf):
    """A list that names every file twice; copies keep their folder below the list's base."""
    source, target, lists = shared_folder(spark), shared_folder(spark), shared_folder(spark)
    datasource.save(views.conversations(spark, sf).withColumn("grid_id", F.concat(F.lit("copy/"), F.col("grid_id").cast("string"))), source)
    paths = gridfile.list_files(spark, source).select("path")
    paths.unionByName(paths).write.text(lists)
    base = paths.select(F.regexp_replace("path", "/copy/[^/]*$", "")).first()
    tables.import_files(spark, lists, target, base[0] if base else None)
    return datasource.load(spark, target).where("tier_name = 'text'").select("grid_id", "idx", "mark")


@query("s18_json_mapping", f"WITH {SQL_EVENTS} SELECT grid_id, idx, upper(mark) AS mark FROM iv")
def s18(spark, sf):
    """A mapping as a JSON file of all marks, then read and applied."""
    iv = views.events(spark, sf)
    path = shared_folder(spark)
    entries = F.map_from_entries(F.collect_set(F.struct("mark", F.upper("mark"))))
    iv.select("mark").distinct().agg(F.to_json(entries).alias("value")).write.text(path)
    return marks.map_marks(iv, tables.read_mapping(spark, path)).select("grid_id", "idx", "mark")


@query("s20_dictionary_file", f"WITH {SQL_EVENTS},{SQL_PHASES}, p AS (SELECT ph.grid_id, ph.idx, list(iv.mark ORDER BY iv.idx) AS parts FROM ph JOIN iv ON iv.grid_id = ph.grid_id AND iv.t0 >= ph.t0 AND iv.t1 <= ph.t1 WHERE iv.mark <> '' GROUP BY ph.grid_id, ph.idx) SELECT 'phase' AS word, array_to_string(parts, ' ') AS pronunciation, count(*) AS weight FROM p GROUP BY parts")
def s20(spark, sf):
    """The dictionary of the phases, written and read back."""
    path = shared_folder(spark)
    tables.write_dictionary(dictionary.pronunciations(views.with_phases(views.events(spark, sf)), "phases", "events"), path)
    return tables.read_dictionary(spark, path, weights=True).withColumn("pronunciation", F.array_join("pronunciation", " "))


@query("s21_csv", f"WITH {SQL_EVENTS} SELECT mark, count(*) AS n FROM iv WHERE mark NOT IN ('', ' ') GROUP BY mark")
def s21(spark, sf):
    path = shared_folder(spark)
    tables.write_csv(stats.vocabulary(views.events(spark, sf)), path, sep=";")
    return spark.read.option("header", True).option("sep", ";").schema("mark string, n long").csv(path)
