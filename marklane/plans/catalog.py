"""Queries by name and the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import in_marks
from ..operators import alignment, comparison, creation, dictionary, joining, lookup, marks, selection, splitting, stats, tiers, validation
from . import file_queries, views
from .registry import ORACLES, QUERIES, plain, query
from .views import SQL_EVENTS, SQL_JITTER, SQL_PHASES

__all__ = ["ORACLES", "QUERIES", "file_queries", "ship"]
def merged(chunked: str, ctes: str = "", sep: str = " ") -> str:
    """SQL of merged chunks; ``chunked`` has the columns of iv and a chunk."""
    head = "WITH RECURSIVE " if "RECURSIVE" in ctes else "WITH "
    more = ctes.replace("RECURSIVE", "")
    return f"""{head}{SQL_EVENTS}{more}, chunked AS ({chunked})
SELECT grid_id, row_number() OVER (PARTITION BY grid_id ORDER BY chunk) - 1 AS idx, t0, t1, mark FROM (
  SELECT grid_id, chunk, min(t0) AS t0, max(t1) AS t1, coalesce(string_agg(mark, '{sep}' ORDER BY idx) FILTER (mark <> ''), '') AS mark
  FROM chunked GROUP BY grid_id, chunk)"""


SECOND = 1_000_000
HOUR = 3_600 * SECOND


def _between_sql(hit: str, threshold: int) -> tuple[str, str]:
    ctes = f"""
, h AS (SELECT *, {hit} AS hit FROM iv
), r AS (SELECT *, sum(ch) OVER (PARTITION BY grid_id ORDER BY idx) AS run FROM (
  SELECT *, CASE WHEN hit = lag(hit) OVER (PARTITION BY grid_id ORDER BY idx) THEN 0 ELSE 1 END AS ch FROM h)
), s AS (SELECT *, hit AND sum(t1 - t0) OVER (PARTITION BY grid_id, run) > {threshold} AS solo FROM r)"""
    return "SELECT *, sum(br) OVER (PARTITION BY grid_id ORDER BY idx) AS chunk FROM (SELECT *, CASE WHEN solo OR coalesce(lag(solo) OVER (PARTITION BY grid_id ORDER BY idx), TRUE) THEN 1 ELSE 0 END AS br FROM s)", ctes


@query("i1_join_all", merged("SELECT *, 0 AS chunk FROM iv"))
def i1(spark, sf):
    return plain(joining.join_all(views.events(spark, sf)))


@query("i2_join_between_marks", merged(*_between_sql("mark IN ('click', 'signup')", 8 * HOUR)))
def i2(spark, sf):
    return plain(joining.join_between_marks(views.events(spark, sf), ["click", "signup"], 8 * HOUR))


@query("i3_join_between_pauses", merged(*_between_sql("trim(mark) = ''", 4 * HOUR)))
def i3(spark, sf):
    return plain(joining.join_between_pauses(views.events(spark, sf), 4 * HOUR))


@query("i4_join_by_boundary", merged("SELECT iv.*, sum(CASE WHEN b.t IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY iv.grid_id ORDER BY idx) AS chunk FROM iv LEFT JOIN b ON iv.grid_id = b.grid_id AND iv.t0 = b.t", f",{SQL_PHASES}, b AS (SELECT grid_id, t0 AS t FROM ph)"))
def i4(spark, sf):
    rows = views.with_phases(views.events(spark, sf))
    return plain(selection.tiers_named(joining.join_by_boundary(rows, "phases", ["events"]), ["events"]))


_FOLD5 = f"""RECURSIVE, f(grid_id, idx, cur, chunk) AS (
  SELECT grid_id, idx, t1 - t0, 1 FROM iv WHERE idx = 0
  UNION ALL
  SELECT i.grid_id, i.idx, CASE WHEN f.cur + i.t1 - i.t0 <= {24 * HOUR} THEN f.cur + i.t1 - i.t0 ELSE i.t1 - i.t0 END, f.chunk + CASE WHEN f.cur + i.t1 - i.t0 <= {24 * HOUR} THEN 0 ELSE 1 END
  FROM f JOIN iv i ON i.grid_id = f.grid_id AND i.idx = f.idx + 1)"""


@query("i5_join_by_duration_all", merged("SELECT iv.*, f.chunk FROM iv JOIN f ON iv.grid_id = f.grid_id AND iv.idx = f.idx", _FOLD5))
def i5(spark, sf):
    return plain(joining.join_by_duration(views.events(spark, sf), 24 * HOUR, include_pauses=True))


_FOLD6 = f"""RECURSIVE, d AS (SELECT *, t1 - t0 AS d, trim(mark) = '' AS p FROM iv), f(grid_id, idx, content, pending, seen, chunk) AS (
  SELECT grid_id, idx, CASE WHEN p THEN 0 ELSE d END, CASE WHEN p THEN d ELSE 0 END, NOT p, 1 FROM d WHERE idx = 0
  UNION ALL
  SELECT grid_id, idx,
    CASE WHEN nw <= {24 * HOUR} THEN nw WHEN p THEN 0 ELSE d END,
    CASE WHEN p THEN CASE WHEN nw <= {24 * HOUR} THEN pending + d ELSE d END ELSE 0 END,
    CASE WHEN nw <= {24 * HOUR} THEN seen OR NOT p ELSE NOT p END,
    chunk + CASE WHEN nw <= {24 * HOUR} THEN 0 ELSE 1 END
  FROM (SELECT i.grid_id, i.idx, i.d, i.p, f.content, f.pending, f.seen, f.chunk, CASE WHEN i.p THEN f.content WHEN f.seen THEN f.content + f.pending + i.d ELSE i.d END AS nw
    FROM f JOIN d i ON i.grid_id = f.grid_id AND i.idx = f.idx + 1))
, g AS (SELECT d.*, f.chunk AS c, min(CASE WHEN NOT p THEN d.idx END) OVER (PARTITION BY d.grid_id, f.chunk) AS lo, max(CASE WHEN NOT p THEN d.idx END) OVER (PARTITION BY d.grid_id, f.chunk) AS hi FROM d JOIN f ON d.grid_id = f.grid_id AND d.idx = f.idx)
, k AS (SELECT *, coalesce(idx BETWEEN lo AND hi, FALSE) AS inn FROM g)"""


@query("i6_join_by_duration", merged("SELECT *, sum(br) OVER (PARTITION BY grid_id ORDER BY idx) AS chunk FROM (SELECT *, CASE WHEN NOT inn OR NOT coalesce(lag(inn) OVER (PARTITION BY grid_id ORDER BY idx), FALSE) OR c <> lag(c) OVER (PARTITION BY grid_id ORDER BY idx) THEN 1 ELSE 0 END AS br FROM k)", _FOLD6))
def i6(spark, sf):
    return plain(joining.join_by_duration(views.events(spark, sf), 24 * HOUR))


def _islands_sql(hit: str) -> str:
    return f"SELECT *, sum(br) OVER (PARTITION BY grid_id ORDER BY idx) AS chunk FROM (SELECT *, CASE WHEN hit AND coalesce(lag(hit) OVER (PARTITION BY grid_id ORDER BY idx), FALSE) THEN 0 ELSE 1 END AS br FROM (SELECT *, {hit} AS hit FROM iv))"


@query("i7_join_marks", merged(_islands_sql("mark IN ('view', '')")))
def i7(spark, sf):
    return plain(joining.join_marks(views.events(spark, sf), ["view"], empty=True))


def _symbols_sql(order: str) -> tuple[str, str]:
    ctes = f"""
, j AS (SELECT *, mark IN ('click', 'view') AS jn FROM iv
), r AS (SELECT *, sum(CASE WHEN jn THEN 0 ELSE 1 END) OVER (PARTITION BY grid_id ORDER BY idx {order}) AS run FROM j
), k AS (SELECT *, bool_or(NOT jn AND mark <> '') OVER (PARTITION BY grid_id, run) AS kept FROM r)"""
    return "SELECT *, sum(br) OVER (PARTITION BY grid_id ORDER BY idx) AS chunk FROM (SELECT *, CASE WHEN kept AND run = lag(run) OVER (PARTITION BY grid_id ORDER BY idx) THEN 0 ELSE 1 END AS br FROM k)", ctes


@query("i8_join_symbols_right", merged(*_symbols_sql("ASC"), sep=""))
def i8(spark, sf):
    return plain(joining.join_symbols(views.events(spark, sf), "right", ["click", "view"], [""]))


@query("i9_join_symbols_left", merged(*_symbols_sql("DESC"), sep=""))
def i9(spark, sf):
    return plain(joining.join_symbols(views.events(spark, sf), "left", ["click", "view"], [""]))


@query("i10_join_symbols_together", merged(_islands_sql("mark IN ('click', 'view')"), sep=""))
def i10(spark, sf):
    return plain(joining.join_symbols(views.events(spark, sf), "together", ["click", "view"], [""]))


_TEMPLATE = f"""RECURSIVE,{SQL_PHASES}, m AS (SELECT iv.*, EXISTS (SELECT 1 FROM ph WHERE ph.grid_id = iv.grid_id AND ph.t0 = iv.t0) AS bd FROM iv), f(grid_id, idx, k, e) AS (
  SELECT grid_id, idx, CASE WHEN mark = 'click' THEN 1 ELSE 0 END, FALSE FROM m WHERE idx = 0
  UNION ALL
  SELECT grid_id, idx, CASE WHEN nk = 2 THEN 0 ELSE nk END, nk = 2 FROM (
    SELECT m.grid_id, m.idx, CASE WHEN m.mark = CASE WHEN m.bd OR f.k = 0 THEN 'click' ELSE 'view' END THEN CASE WHEN m.bd THEN 1 ELSE f.k + 1 END WHEN m.mark = 'click' THEN 1 ELSE 0 END AS nk
    FROM f JOIN m ON m.grid_id = f.grid_id AND m.idx = f.idx + 1))
, e AS (SELECT iv.*, f.e, coalesce(lead(f.e) OVER (PARTITION BY iv.grid_id ORDER BY iv.idx), FALSE) AS nx FROM iv JOIN f ON iv.grid_id = f.grid_id AND iv.idx = f.idx)"""


@query("i11_join_template", merged("SELECT *, sum(CASE WHEN e THEN 0 ELSE 1 END) OVER (PARTITION BY grid_id ORDER BY idx) AS chunk FROM e", _TEMPLATE))
def i11(spark, sf):
    rows = views.with_phases(views.events(spark, sf))
    return plain(selection.tiers_named(joining.join_template(rows, ["click", "view"], "phases", tiers=["events"]), ["events"]))


@query("i12_content_runs", f"WITH {SQL_EVENTS}, h AS (SELECT *, trim(mark) <> '' AS c FROM iv), r AS (SELECT *, sum(ch) OVER (PARTITION BY grid_id ORDER BY idx) AS run FROM (SELECT *, CASE WHEN c = lag(c) OVER (PARTITION BY grid_id ORDER BY idx) THEN 0 ELSE 1 END AS ch FROM h)) SELECT grid_id, CAST(run AS BIGINT) AS run, c AS is_content, min(idx) AS first, max(idx) AS last FROM r GROUP BY ALL")
def i12(spark, sf):
    return joining.content_runs(views.events(spark, sf)).drop("tier_idx")


_CHARS = "CASE WHEN text = '' THEN [''] ELSE string_split(text, ' ') END"


@query("x1_split_intervals", f"SELECT conv_id AS grid_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS idx, turn + CASE WHEN i = 1 THEN 0 ELSE ((i - 1) / n::DOUBLE) * 1 END AS t0, CASE WHEN i = n THEN turn + 1 ELSE turn + (i / n::DOUBLE) * 1 END AS t1, p[i] AS mark FROM (SELECT conv_id, turn, p, len(p) AS n, unnest(range(1, len(p) + 1)) AS i FROM (SELECT conv_id, turn, {_CHARS} AS p FROM conversations))")
def x1(spark, sf):
    rows = selection.tiers_named(views.conversations(spark, sf), ["text"])
    return plain(splitting.split_intervals(rows, " "))


@query("x3_text_to_tier", f"SELECT doc_id AS grid_id, i - 1 AS idx, CASE WHEN i = 1 THEN 0 ELSE ((i - 1) / n::DOUBLE) * n_chars END AS t0, CASE WHEN i = n THEN n_chars ELSE (i / n::DOUBLE) * n_chars END AS t1, p[i] AS mark FROM (SELECT doc_id, n_chars, p, len(p) AS n, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, n_chars, string_split(text, chr(10)) AS p FROM documents))")
def x3(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    grids = docs.select(F.col("doc_id").alias("grid_id"), F.lit(0).alias("t0"), F.col("n_chars").alias("t1"))
    return plain(splitting.text_to_tier(grids, docs.select(F.col("doc_id").alias("grid_id"), "text"), "lines", 1))


@query("x4_tier_to_text", f"WITH {SQL_EVENTS} SELECT grid_id, string_agg(mark, '|' ORDER BY idx) AS text FROM iv GROUP BY grid_id")
def x4(spark, sf):
    return splitting.tier_to_text(views.events(spark, sf), "|").drop("tier_idx")


@query("x5_transcribe", f"WITH {SQL_EVENTS}, d(w, p) AS (VALUES ('click', ['k', 'l', 'i', 'k']), ('view', ['v', 'u'])), j AS (SELECT grid_id, idx, t0, t1, coalesce(p, [mark]) AS p FROM iv LEFT JOIN d ON w = mark), u AS (SELECT *, len(p) AS n, unnest(range(1, len(p) + 1)) AS i FROM j) SELECT grid_id, row_number() OVER (PARTITION BY grid_id ORDER BY idx, i) - 1 AS idx, CASE WHEN i = 1 THEN t0::DOUBLE ELSE t0 + ((i - 1) / n::DOUBLE) * (t1 - t0) END AS t0, CASE WHEN i = n THEN t1::DOUBLE ELSE t0 + (i / n::DOUBLE) * (t1 - t0) END AS t1, p[i] AS mark FROM u")
def x5(spark, sf):
    words = spark.createDataFrame([("click", ["k", "l", "i", "k"], 3), ("view", ["v", "u"], 1)], "word string, pronunciation array<string>, weight long")
    return plain(dictionary.transcribe(views.events(spark, sf), words, ["events"]))


@query("x6_create_grids", "WITH d AS (SELECT doc_id AS grid_id, text, length(text) / 15.0::DOUBLE AS size FROM documents WHERE text <> ''), p AS (SELECT grid_id, 0 AS k, 0.0::DOUBLE AS t0, 0.5::DOUBLE AS t1, '' AS mark FROM d WHERE size > 0.5 UNION ALL SELECT grid_id, 1, 0.5, size, text FROM d WHERE size > 0.5) SELECT grid_id, k AS idx, t0, t1, mark FROM p")
def x6(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return plain(creation.create_grids(docs.select(F.col("doc_id").alias("grid_id"), "text", F.lit(0.5).alias("start"))))


@query("x7_split_grids", f"WITH {SQL_EVENTS},{SQL_PHASES}, n AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY idx) - 1 AS k, count(*) OVER (PARTITION BY grid_id) AS n FROM ph), j AS (SELECT iv.grid_id || '/' || lpad(CAST(k AS VARCHAR), CAST(length(CAST(n AS VARCHAR)) AS INTEGER), '0') AS g, iv.idx, iv.t0 - n.t0 AS t0, iv.t1 - n.t0 AS t1, iv.mark FROM iv JOIN n ON iv.grid_id = n.grid_id AND iv.t0 >= n.t0 AND iv.t1 <= n.t1) SELECT g AS grid_id, row_number() OVER (PARTITION BY g ORDER BY idx) - 1 AS idx, t0, t1, mark FROM j")
def x7(spark, sf):
    rows = views.with_phases(views.events(spark, sf))
    return plain(selection.tiers_named(splitting.split_grids(rows, "phases"), ["events"]))


def _snap_sql(edges: str, points: str, threshold: str) -> str:
    """CTEs that end in fx (grid_id, i, t0, t1): the edges (grid_id, e, a sorted list) after the points (grid_id, t) were taken in order."""
    return f"""
pt AS (SELECT grid_id, t, row_number() OVER (PARTITION BY grid_id ORDER BY t) AS k FROM ({points})
), st(grid_id, k, e) AS (
  SELECT grid_id, 0, e FROM ({edges})
  UNION ALL
  SELECT grid_id, k, list_transform(e, lambda x, i: CASE WHEN i = mv THEN t ELSE x END) FROM (
    SELECT grid_id, k, t, e, CASE WHEN p < len(e) AND e[p + 1] = t THEN 0
      WHEN p = 0 THEN CASE WHEN e[1] - t < {threshold} THEN 1 ELSE 0 END
      WHEN p = len(e) THEN CASE WHEN t - e[p] < {threshold} THEN p ELSE 0 END
      WHEN t - e[p] <= e[p + 1] - t THEN CASE WHEN t - e[p] <= {threshold} THEN p ELSE 0 END
      WHEN e[p + 1] - t <= {threshold} THEN p + 1 ELSE 0 END AS mv
    FROM (SELECT st.grid_id, pt.k, pt.t, st.e, len(list_filter(st.e, lambda x: x < pt.t)) AS p FROM st JOIN pt ON pt.grid_id = st.grid_id AND pt.k = st.k + 1))
), fx AS (
  SELECT grid_id, i, e[i] AS t0, e[i + 1] AS t1 FROM (
    SELECT grid_id, e, unnest(range(1, len(e))) AS i FROM (SELECT grid_id, max_by(e, k) AS e FROM st GROUP BY grid_id))
)"""


_EDGES = "SELECT grid_id, list_append(list(t0 ORDER BY idx), max_by(t1, idx)) AS e FROM {0} GROUP BY grid_id"
_POINTS = "SELECT grid_id, t0 AS t FROM {0} UNION SELECT grid_id, t1 FROM {0}"


_MERGED = """
r AS (SELECT grid_id % 10 AS new, grid_id, idx, t1 - t0 AS d, mark FROM {0}
), n AS (SELECT new, count(DISTINCT grid_id) AS n FROM r GROUP BY new
), {1} AS (SELECT new AS grid_id, row_number() OVER w - 1 AS idx, CAST(sum(d) OVER w - d AS BIGINT) AS t0, CAST(sum(d) OVER w AS BIGINT) AS t1, mark
  FROM r JOIN n USING (new) WHERE n > 1 WINDOW w AS (PARTITION BY new ORDER BY grid_id, idx)
), {1}_alone AS (SELECT new AS grid_id, {0}.idx, t0, t1, {0}.mark FROM {0} JOIN n ON new = {0}.grid_id % 10 WHERE n = 1)"""


@query("x9_merge_grids", f"WITH {SQL_EVENTS},{_MERGED.format('iv', 'mg')} SELECT * FROM mg UNION ALL SELECT * FROM mg_alone")
def x9(spark, sf):
    return plain(alignment.merge_grids(views.events(spark, sf), F.col("grid_id") % 10))


@query("x9_merge_two_tiers", f"""WITH RECURSIVE {SQL_EVENTS}, f AS (SELECT grid_id, idx, t0, t1, mark FROM iv WHERE idx < 12), h AS (SELECT grid_id, idx, t0 - idx * 1000 AS t0, t1 - (idx + 1) * 1000 AS t1, mark FROM f WHERE t1 - t0 > 100000),
ra AS (SELECT grid_id % 10 AS new, grid_id, idx, t1 - t0 AS d, mark FROM f), rb AS (SELECT grid_id % 10 AS new, grid_id, idx, t1 - t0 AS d, mark FROM h), nn AS (SELECT new FROM ra GROUP BY new HAVING count(DISTINCT grid_id) > 1),
ma AS (SELECT new AS grid_id, CAST(sum(d) OVER w - d AS BIGINT) AS t0, CAST(sum(d) OVER w AS BIGINT) AS t1 FROM ra JOIN nn USING (new) WINDOW w AS (PARTITION BY new ORDER BY grid_id, idx)),
mb AS (SELECT new AS grid_id, row_number() OVER w AS idx, CAST(sum(d) OVER w - d AS BIGINT) AS t0, CAST(sum(d) OVER w AS BIGINT) AS t1, mark FROM rb JOIN nn USING (new) WINDOW w AS (PARTITION BY new ORDER BY grid_id, idx)),
{_snap_sql(_EDGES.format('mb'), _POINTS.format('ma'), '1e300')}
SELECT fx.grid_id, row_number() OVER (PARTITION BY fx.grid_id ORDER BY i) - 1 AS idx, fx.t0, fx.t1, mark FROM fx JOIN mb ON mb.grid_id = fx.grid_id AND mb.idx = fx.i WHERE fx.t0 < fx.t1""")
def x9b(spark, sf):
    """A second tier of other durations, aligned to the first after merging; groups of several grids."""
    first = views.events(spark, sf).where("idx < 12")
    second = first.where("t1 - t0 > 100000").withColumns({"t0": F.col("t0") - F.col("idx") * 1000, "t1": F.col("t1") - (F.col("idx") + 1) * 1000, "tier_idx": F.lit(1), "tier_name": F.lit("second")})
    both = first.unionByName(second).withColumn("_g", F.col("grid_id") % 10)
    several = both.groupBy("_g").agg(F.countDistinct("grid_id").alias("n")).where("n > 1")
    merged = alignment.merge_grids(both.join(several, "_g", "left_semi").drop("_g"), F.col("grid_id") % 10)
    return plain(selection.tiers_named(merged, ["second"]))


@query("b1_fix_boundaries", f"WITH RECURSIVE {SQL_EVENTS},{SQL_JITTER},{_snap_sql(_EDGES.format('iv'), _POINTS.format('ji'), '1000000')} SELECT grid_id, row_number() OVER (PARTITION BY grid_id ORDER BY i) - 1 AS idx, t0, t1, mark FROM (SELECT fx.*, m.mark FROM fx JOIN (SELECT grid_id, row_number() OVER (PARTITION BY grid_id ORDER BY idx) AS i, mark FROM iv) m ON m.grid_id = fx.grid_id AND m.i = fx.i WHERE t0 < t1)")
def b1(spark, sf):
    iv = views.events(spark, sf)
    other = views.jittered(iv).withColumns({"tier_idx": F.lit(1), "tier_name": F.lit("reference")})
    return plain(selection.tiers_named(alignment.fix_boundaries(iv.unionByName(other), "reference", ["events"], 1_000_000), ["events"]))


@query("b1a_fix_all_boundaries", f"WITH RECURSIVE {SQL_EVENTS},{SQL_PHASES},{_snap_sql(_EDGES.format('iv'), _POINTS.format('(SELECT grid_id, t0 + 700000 AS t0, t1 + 700000 AS t1 FROM ph)'), '1e300')} SELECT grid_id, row_number() OVER (PARTITION BY grid_id ORDER BY i) - 1 AS idx, t0, t1, mark FROM (SELECT fx.*, m.mark FROM fx JOIN (SELECT grid_id, row_number() OVER (PARTITION BY grid_id ORDER BY idx) AS i, mark FROM iv) m ON m.grid_id = fx.grid_id AND m.i = fx.i WHERE t0 < t1)")
def b1a(spark, sf):
    """Without a limit, and with timepoints behind the last boundary."""
    rows = views.with_phases(views.events(spark, sf))
    late = F.when(F.col("tier_name") == "phases", 700_000).otherwise(0)
    moved = rows.withColumns({"t0": F.col("t0") + late, "t1": F.col("t1") + late})
    return plain(selection.tiers_named(alignment.fix_boundaries(moved, "phases", ["events"], float("inf")), ["events"]))


@query("b2_sync_to_audio", f"WITH {SQL_EVENTS}, g AS (SELECT grid_id, max(idx) AS m, max(t1) AS e FROM iv GROUP BY grid_id) SELECT iv.grid_id, idx, CASE WHEN idx = 0 THEN 0.0 ELSE t0 / 1000000.0::DOUBLE END AS t0, CASE WHEN idx = m THEN (e // 1000000 + 1) * 16000 / 16000::DOUBLE ELSE t1 / 1000000.0::DOUBLE END AS t1, mark FROM iv JOIN g ON iv.grid_id = g.grid_id")
def b2(spark, sf):
    iv = views.events(spark, sf).withColumns({"t0": F.col("t0") / 1e6, "t1": F.col("t1") / 1e6})
    audio = iv.groupBy("grid_id").agg(((F.floor(F.max("t1")) + 1) * 16000).alias("n_samples"), F.lit(16000).alias("sample_rate"))
    return plain(alignment.sync_to_audio(iv, audio))


_CUT = f"WITH {SQL_EVENTS}, c AS (SELECT *, mark = '' AS cut FROM iv), s AS (SELECT *, coalesce(sum(CASE WHEN cut THEN t1 - t0 ELSE 0 END) OVER (PARTITION BY grid_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM c) SELECT grid_id, row_number() OVER (PARTITION BY grid_id ORDER BY idx) - 1 AS idx, CAST(t0 - gone AS BIGINT) AS t0, CAST(t1 - gone AS BIGINT) AS t1, mark FROM s WHERE NOT cut"


@query("b3_remove_spans", _CUT)
def b3(spark, sf):
    iv = views.events(spark, sf)
    return plain(alignment.remove_spans(iv, alignment.spans_with_marks(iv, "events", [""])))


@query("m1_map_marks", f"WITH {SQL_EVENTS} SELECT grid_id, idx, t0, t1, CASE mark WHEN '' THEN '' WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE 'other' END AS mark FROM iv")
def m1(spark, sf):
    return plain(marks.map_marks(views.events(spark, sf), {"click": "C", "view": "V"}, unmapped="other", replace_unmapped=True))


@query("m2_replace_text", f"WITH {SQL_EVENTS} SELECT grid_id, idx, t0, t1, regexp_replace(mark, '^(c|v)(.)', '\\2\\1') AS mark FROM iv")
def m2(spark, sf):
    return plain(marks.replace_text(views.events(spark, sf), r"^(c|v)(.)", r"\2\1"))


@query("m3_map_tier", "SELECT conv_id AS grid_id, turn AS idx, turn AS t0, turn + 1 AS t1, role || text AS mark FROM conversations")
def m3(spark, sf):
    return plain(selection.tiers_named(marks.map_tier(views.conversations(spark, sf), "role", "text", "prepend"), ["text"]))


@query("m4_remove_symbols", f"WITH {SQL_EVENTS} SELECT grid_id, idx, t0, t1, CASE WHEN mark = 'signup' THEN '' WHEN replace(mark, 'view', '') = '' THEN '' ELSE replace(replace(mark, 'c', ''), 'k', '') END AS mark FROM iv")
def m4(spark, sf):
    return plain(marks.remove_symbols(views.events(spark, sf), ["c", "k"], ["view"], ["signup"]))


@query("m5_mark_silence", f"WITH {SQL_EVENTS} SELECT grid_id, idx, t0, t1, CASE WHEN mark = '' AND t1 - t0 >= {HOUR} AND t1 - t0 < {9 * HOUR} THEN 'sil' ELSE mark END AS mark FROM iv")
def m5(spark, sf):
    return plain(marks.mark_silence(views.events(spark, sf), "sil", HOUR, 9 * HOUR))


_PERCENTILES = f"""WITH {SQL_EVENTS}, g AS (SELECT {{keys}}, list((t1 - t0) ORDER BY t1 - t0) AS d, count(*) AS n FROM iv WHERE mark IN ('click', 'view') GROUP BY {{keys}}),
q AS (SELECT *, (n - 1) * 0.05::DOUBLE AS p5, (n - 1) * 0.9::DOUBLE AS p90 FROM g),
b AS (SELECT *, d[CAST(floor(p5) AS BIGINT) + 1]::DOUBLE AS a5, d[least(CAST(floor(p5) AS BIGINT) + 1, n - 1) + 1]::DOUBLE AS b5, p5 - floor(p5) AS t5, d[CAST(floor(p90) AS BIGINT) + 1]::DOUBLE AS a9, d[least(CAST(floor(p90) AS BIGINT) + 1, n - 1) + 1]::DOUBLE AS b9, p90 - floor(p90) AS t9 FROM q),
c AS (SELECT *, CASE WHEN t5 >= 0.5 THEN b5 - (b5 - a5) * (1 - t5) ELSE a5 + (b5 - a5) * t5 END AS lo, CASE WHEN t9 >= 0.5 THEN b9 - (b9 - a9) * (1 - t9) ELSE a9 + (b9 - a9) * t9 END AS hi FROM b)"""


@query("m6_label_durations", _PERCENTILES.format(keys="mark") + " SELECT iv.grid_id, idx, t0, t1, CASE WHEN t1 - t0 >= lo AND t1 - t0 < hi AND n >= 2 THEN 'usual' ELSE iv.mark END AS mark FROM iv LEFT JOIN c ON iv.mark = c.mark")
def m6(spark, sf):
    iv = views.events(spark, sf)
    return plain(stats.label_durations(iv, "events", "events", "usual", ["click", "view"], [], 5, 90, min_count=2))


@query("a6_duration_bounds", _PERCENTILES.format(keys="grid_id, mark") + " SELECT grid_id, mark, n, lo, hi FROM c")
def a6(spark, sf):
    rows = views.events(spark, sf).where(in_marks(["click", "view"]))
    return stats.duration_bounds(rows, ["grid_id"], 5, 90)


@query("t1_rename_tier", "SELECT conv_id AS grid_id, 0 AS tier_idx, 'said' AS tier_name, turn AS idx FROM conversations UNION ALL SELECT conv_id, 1, 'role', turn FROM conversations")
def t1(spark, sf):
    return tiers.rename_tier(views.conversations(spark, sf), "text", "said").select("grid_id", "tier_idx", "tier_name", "idx")


@query("t2_clone_tier", "SELECT conv_id AS grid_id, i AS tier_idx, n AS tier_name, turn AS idx, CASE i WHEN 0 THEN text WHEN 1 THEN role ELSE '' END AS mark FROM conversations, (VALUES (0, 'text'), (1, 'role'), (2, 'x'), (3, 'y')) v(i, n)")
def t2(spark, sf):
    return tiers.clone_tier(views.conversations(spark, sf), "role", ["x", "y"], ignore_marks=True).select("grid_id", "tier_idx", "tier_name", "idx", "mark")


@query("t3_move_tier", "SELECT conv_id AS grid_id, 1 AS tier_idx, 'text' AS tier_name, turn AS idx FROM conversations UNION ALL SELECT conv_id, 0, 'role', turn FROM conversations")
def t3(spark, sf):
    return tiers.move_tier(views.conversations(spark, sf), "role", 1).select("grid_id", "tier_idx", "tier_name", "idx")


@query("t4_append_tier", "SELECT conv_id AS grid_id, i AS tier_idx, n AS tier_name, turn AS idx FROM conversations, (VALUES (0, 'text'), (1, 'role'), (2, 'again')) v(i, n)")
def t4(spark, sf):
    rows = views.conversations(spark, sf)
    new = selection.tiers_named(rows, ["role"]).withColumn("tier_name", F.lit("again"))
    return tiers.append_tier(rows, new).select("grid_id", "tier_idx", "tier_name", "idx")


@query("f5_lasting", f"WITH {SQL_EVENTS} SELECT grid_id, idx, t0, t1, mark FROM iv WHERE t1 - t0 >= {HOUR} AND t1 - t0 < {5 * HOUR}")
def f5(spark, sf):
    return plain(selection.lasting(views.events(spark, sf), HOUR, 5 * HOUR))


@query("f6_considered", f"WITH {SQL_EVENTS} SELECT grid_id, idx, t0, t1, mark FROM iv WHERE mark NOT IN ('click', '')")
def f6(spark, sf):
    return plain(selection.considered(views.events(spark, sf), ["click", ""], "ignore"))


_SPAN = (1_704_499_200 * SECOND, 1_705_104_000 * SECOND)


@query("f7_contained", f"WITH {SQL_EVENTS} SELECT grid_id, idx, t0, t1, mark FROM iv WHERE t0 >= {_SPAN[0]} AND t1 <= {_SPAN[1]}")
def f7(spark, sf):
    return plain(selection.contained(views.events(spark, sf), *_SPAN))


@query("f8_part_of", f"WITH {SQL_EVENTS} SELECT grid_id, idx, t0, t1, mark FROM iv WHERE (t0 >= {_SPAN[0]} AND t0 < {_SPAN[1]}) OR (t1 > {_SPAN[0]} AND t1 <= {_SPAN[1]})")
def f8(spark, sf):
    return plain(selection.part_of(views.events(spark, sf), *_SPAN))


@query("f9_filling", f"WITH {SQL_EVENTS},{SQL_PHASES}, j AS (SELECT iv.*, ph.t0 AS lo, ph.t1 AS hi FROM iv JOIN ph ON iv.grid_id = ph.grid_id AND iv.t0 >= ph.t0 AND iv.t1 <= ph.t1), w AS (SELECT *, min(t0) OVER (PARTITION BY grid_id, lo, hi) AS a, max(t1) OVER (PARTITION BY grid_id, lo, hi) AS b FROM j) SELECT grid_id, idx, t0, t1, mark FROM w WHERE a = lo AND b = hi")
def f9(spark, sf):
    rows = views.with_phases(views.events(spark, sf))
    spans = selection.tiers_named(rows, ["phases"]).select("grid_id", F.col("t0").alias("lo"), F.col("t1").alias("hi"))
    return plain(selection.filling(selection.tiers_named(rows, ["events"]), spans))


def _ends_sql(hit: str) -> str:
    return f"WITH {SQL_EVENTS}, h AS (SELECT *, min(CASE WHEN NOT ({hit}) THEN idx END) OVER (PARTITION BY grid_id) AS lo, max(CASE WHEN NOT ({hit}) THEN idx END) OVER (PARTITION BY grid_id) AS hi FROM iv) SELECT grid_id, idx, t0, t1, mark FROM h WHERE lo IS NULL OR idx < lo OR idx > hi"


@query("f10_at_ends", _ends_sql("mark IN ('click', 'view', 'purchase')"))
def f10(spark, sf):
    return plain(selection.at_ends(views.events(spark, sf), ["click", "view", "purchase"], "both"))


@query("f11_matching", _ends_sql("regexp_matches(mark, '[cvp]')"))
def f11(spark, sf):
    return plain(selection.matching(views.events(spark, sf), "[cvp]", "both"))


@query("f12_very_short", f"WITH {SQL_EVENTS} SELECT grid_id, idx, t0, t1, mark FROM iv WHERE t1 - t0 < {HOUR}")
def f12(spark, sf):
    return plain(selection.very_short(views.events(spark, sf), HOUR))


@query("f13_remove_tiers", "SELECT conv_id AS grid_id, 0 AS tier_idx, 'role' AS tier_name, turn AS idx FROM conversations")
def f13(spark, sf):
    return selection.remove_tiers(views.conversations(spark, sf), ["text"]).select("grid_id", "tier_idx", "tier_name", "idx")


@query("a1_vocabulary", f"WITH {SQL_EVENTS} SELECT mark, count(*) AS n FROM iv WHERE mark NOT IN ('', ' ') GROUP BY mark")
def a1(spark, sf):
    return stats.vocabulary(views.events(spark, sf))


@query("a2_duration_stats", f"WITH {SQL_EVENTS}, d AS (SELECT max(t1) - min(t0) AS d FROM iv GROUP BY grid_id) SELECT count(d) AS n, min(d) AS shortest, median(d)::DOUBLE AS median, max(d) AS longest, round(avg(d), 3) AS mean, round(stddev_pop(d), 3) AS sd, round(kurtosis_pop(d), 6) AS kurtosis, CAST(sum(d) AS BIGINT) AS total FROM d")
def a2(spark, sf):
    out = stats.duration_stats(stats.grid_durations(views.events(spark, sf)))
    return out.withColumns({"mean": F.round("mean", 3), "sd": F.round("sd", 3), "kurtosis": F.round("kurtosis", 6)})


@query("a3_marks_table", f"WITH {SQL_EVENTS}, c AS (SELECT 'events' AS tier_name, mark, count(*) AS n FROM iv GROUP BY mark) SELECT tier_name, mark, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 9) AS percent FROM c UNION ALL SELECT 'events', NULL, CAST(sum(n) AS BIGINT), 100.0 FROM c")
def a3(spark, sf):
    return stats.marks_table(views.events(spark, sf)).withColumn("percent", F.round("percent", 9))


@query("a4_tier_stats", f"WITH {SQL_EVENTS} SELECT grid_id, count(*) AS n, min(t1 - t0) AS shortest, max(t1 - t0) AS longest, round(avg(t1 - t0), 3) AS mean FROM iv GROUP BY grid_id")
def a4(spark, sf):
    return stats.tier_stats(views.events(spark, sf)).select("grid_id", "n", "shortest", "longest", F.round("mean", 3).alias("mean"))


@query("a4_symbol_table", f"WITH {SQL_EVENTS}, c AS (SELECT grid_id, mark, count(*) AS n, min(idx) AS f FROM iv GROUP BY grid_id, mark) SELECT grid_id, mark, n, row_number() OVER (PARTITION BY grid_id ORDER BY n DESC, f) AS rank FROM c")
def a4b(spark, sf):
    return stats.symbol_table(views.events(spark, sf)).drop("tier_idx")


_WORDS = f"{SQL_EVENTS},{SQL_PHASES}, p AS (SELECT ph.grid_id, ph.idx, list(iv.mark ORDER BY iv.idx) AS parts FROM ph JOIN iv ON iv.grid_id = ph.grid_id AND iv.t0 >= ph.t0 AND iv.t1 <= ph.t1 WHERE iv.mark <> '' GROUP BY ph.grid_id, ph.idx)"


@query("j1_parts_within", f"WITH {_WORDS} SELECT grid_id, idx, array_to_string(parts, ' ') AS parts FROM p")
def j1(spark, sf):
    rows = views.with_phases(views.events(spark, sf))
    return dictionary.parts_within(rows, "phases", "events").select("grid_id", "idx", F.array_join("parts", " ").alias("parts"))


@query("a5_pronunciations", f"WITH {_WORDS} SELECT 'phase' AS word, array_to_string(parts, ' ') AS pronunciation, count(*) AS weight FROM p GROUP BY parts")
def a5(spark, sf):
    rows = views.with_phases(views.events(spark, sf))
    return dictionary.pronunciations(rows, "phases", "events").withColumn("pronunciation", F.array_join("pronunciation", " "))


_PAIRS = f"WITH {SQL_EVENTS},{SQL_JITTER}, x AS (SELECT iv.mark, (iv.t1 - iv.t0) / 1000.0::DOUBLE AS a, (ji.t1 - ji.t0) / 1000.0::DOUBLE AS b, abs(round_even(((iv.t1 - iv.t0) - (ji.t1 - ji.t0)) * 0.001::DOUBLE, 0)) AS d FROM iv JOIN ji ON iv.grid_id = ji.grid_id AND iv.idx = ji.idx), y AS (SELECT mark AS name, 'mark' AS kind, a, b, d FROM x UNION ALL SELECT '-ALL-', 'group', a, b, d FROM x UNION ALL SELECT 'ui', 'group', a, b, d FROM x WHERE mark IN ('click', 'view'))"


@query("a7_boundary_stats", _PAIRS + " SELECT name, kind, count(*) AS n, round(min(a), 3) AS min_a, round(avg(b), 3) AS mean_b, round(stddev_pop(a), 3) AS sd_a, max(d) AS max_diff, median(d) AS median_diff, round(avg(d), 6) AS mean_diff, sum(d) AS sum_diff, CAST(count(*) FILTER (d > -1 AND d <= 0) AS BIGINT) AS zero, CAST(count(*) FILTER (d > 0 AND d <= 500) AS BIGINT) AS upto500, CAST(count(*) FILTER (d > 500) AS BIGINT) AS above FROM y GROUP BY name, kind")
def a7(spark, sf):
    iv = views.events(spark, sf)
    pairs = comparison.paired(iv, views.jittered(iv), "events")
    out = comparison.boundary_stats(pairs, {"ui": ["click", "view"]}, [500], to_ms=0.001)
    return out.select("name", "kind", "n", F.round("min_a", 3).alias("min_a"), F.round("mean_b", 3).alias("mean_b"), F.round("sd_a", 3).alias("sd_a"), "max_diff", "median_diff", F.round("mean_diff", 6).alias("mean_diff"), "sum_diff", F.col("Match0ms").alias("zero"), F.col("`Match(0,500]ms`").alias("upto500"), F.col("`Match(500,inf]ms`").alias("above"))


@query("j4_mismatches", f"WITH {SQL_EVENTS}, o AS (SELECT grid_id, idx, CASE WHEN mark = 'click' AND idx % 5 = 0 THEN 'tap' ELSE mark END AS mark FROM iv) SELECT iv.grid_id, count(*) AS n FROM iv JOIN o ON iv.grid_id = o.grid_id AND iv.idx = o.idx WHERE iv.mark <> o.mark GROUP BY iv.grid_id")
def j4(spark, sf):
    iv = views.events(spark, sf)
    other = iv.withColumn("mark", F.when((F.col("mark") == "click") & (F.col("idx") % 5 == 0), "tap").otherwise(F.col("mark")))
    return comparison.mismatches(comparison.paired(iv, other, "events"))


@query("a8_marks_text", f"WITH {SQL_EVENTS} SELECT grid_id, string_agg(mark, '|' ORDER BY idx) AS text FROM iv GROUP BY grid_id")
def a8(spark, sf):
    return stats.marks_text(views.events(spark, sf)).drop("tier_idx")


@query("a9_violin_data", f"WITH {SQL_EVENTS} SELECT mark, t1 - t0 AS duration, count(*) AS n FROM iv GROUP BY ALL")
def a9(spark, sf):
    return stats.violin_data(views.events(spark, sf))


@query("s15_grid_durations", f"WITH {SQL_EVENTS} SELECT grid_id, max(t1) - min(t0) AS duration FROM iv GROUP BY grid_id")
def s15(spark, sf):
    return stats.grid_durations(views.events(spark, sf))


@query("v1_missing_boundaries", f"WITH {SQL_EVENTS},{SQL_JITTER}, b AS (SELECT grid_id, t0 AS t FROM iv UNION SELECT grid_id, t1 FROM iv), h AS (SELECT grid_id, t0 AS t FROM ji UNION SELECT grid_id, t1 FROM ji) SELECT b.grid_id, b.t FROM b LEFT JOIN h ON b.grid_id = h.grid_id AND b.t = h.t WHERE h.t IS NULL")
def v1(spark, sf):
    iv = views.events(spark, sf)
    both = iv.unionByName(views.jittered(iv).withColumns({"tier_idx": F.lit(1), "tier_name": F.lit("other")}))
    return validation.missing_boundaries(both, "events", ["other"]).drop("tier_idx")


@query("v2_results", f"WITH {SQL_EVENTS} SELECT grid_id, NULL::VARCHAR AS error, bool_or(mark = 'signup') AS changed FROM iv GROUP BY grid_id")
def v2(spark, sf):
    iv = views.events(spark, sf)
    return validation.results(iv, marks.map_marks(iv, {"signup": "joined"}))



def _shifted_marks_sql(mark: str) -> str:
    """SQL of the event marks under names that the default punctuation knows."""
    return f"CASE {mark} WHEN 'click' THEN '、' WHEN 'view' THEN '~' WHEN 'search' THEN '^' ELSE {mark} END"


def _punctuated(spark, sf):
    return marks.map_marks(views.events(spark, sf), {"click": "、", "view": "~", "search": "^"})


@query("i8_join_symbols_default", f"""WITH {SQL_EVENTS}, q AS (SELECT grid_id, idx, t0, t1, {_shifted_marks_sql('mark')} AS mark FROM iv), j AS (SELECT *, mark IN ('、', '~') AS jn FROM q
), r AS (SELECT *, sum(CASE WHEN jn THEN 0 ELSE 1 END) OVER (PARTITION BY grid_id ORDER BY idx) AS run FROM j
), k AS (SELECT *, bool_or(NOT jn AND mark NOT IN ('', ' ')) OVER (PARTITION BY grid_id, run) AS kept FROM r
), c AS (SELECT *, sum(br) OVER (PARTITION BY grid_id ORDER BY idx) AS chunk FROM (SELECT *, CASE WHEN kept AND run = lag(run) OVER (PARTITION BY grid_id ORDER BY idx) THEN 0 ELSE 1 END AS br FROM k))
SELECT grid_id, row_number() OVER (PARTITION BY grid_id ORDER BY chunk) - 1 AS idx, t0, t1, mark FROM (
  SELECT grid_id, chunk, min(t0) AS t0, max(t1) AS t1, coalesce(string_agg(mark, '' ORDER BY idx), '') AS mark FROM c GROUP BY grid_id, chunk)""")
def i8_default(spark, sf):
    return plain(joining.join_symbols(_punctuated(spark, sf)))


@query("f1_tiers_named", "SELECT conv_id AS grid_id, turn AS idx, turn AS t0, turn + 1 AS t1, role AS mark FROM conversations")
def f1(spark, sf):
    return plain(selection.tiers_named(views.conversations(spark, sf), ["role", "absent"]))


@query("f3_with_marks", f"WITH {SQL_EVENTS} SELECT grid_id, idx, t0, t1, mark FROM iv WHERE mark IN ('click', '')")
def f3(spark, sf):
    return plain(selection.with_marks(views.events(spark, sf), ["click", ""]))


@query("f4_without_marks", f"WITH {SQL_EVENTS} SELECT grid_id, idx, t0, t1, mark FROM iv WHERE mark NOT IN ('click', '')")
def f4(spark, sf):
    return plain(selection.without_marks(views.events(spark, sf), ["click", ""]))


@query("a6_pooled_bounds", _PERCENTILES.format(keys="'events' AS tier_name").replace("GROUP BY 'events' AS tier_name", "GROUP BY ALL") + " SELECT n, lo, hi FROM c")
def a6_pooled(spark, sf):
    rows = views.events(spark, sf).where(in_marks(["click", "view"]))
    return stats.duration_bounds(rows, ["tier_name"], 5, 90, per_mark=False).drop("tier_name")


@query("a6_absolute", f"WITH {SQL_EVENTS} SELECT grid_id, idx, t0, t1, mark FROM iv WHERE mark IN ('click', 'view') AND t1 - t0 >= {HOUR} AND t1 - t0 < {9 * HOUR}")
def a6_absolute(spark, sf):
    return plain(stats.select_durations(views.events(spark, sf), "events", ["click", "view"], [], HOUR, 9 * HOUR, "absolute", per_mark=False))


@query("a6_percent", f"WITH {SQL_EVENTS}, b AS (SELECT grid_id, mark, max(t1 - t0) / 100.0::DOUBLE * 20 AS lo, max(t1 - t0) / 100.0::DOUBLE * 60 AS hi, count(*) AS n FROM iv GROUP BY grid_id, mark) SELECT iv.grid_id, idx, t0, t1, iv.mark FROM iv JOIN b ON iv.grid_id = b.grid_id AND iv.mark = b.mark WHERE n >= 3 AND t1 - t0 >= lo AND t1 - t0 < hi")
def a6_percent(spark, sf):
    return plain(stats.select_durations(views.events(spark, sf), "events", [], ["grid_id"], 20, 60, "percent", min_count=3))


@query("a6_label_counts", _PERCENTILES.format(keys="grid_id, mark") + ", k AS (SELECT iv.*, c.n, lo, hi FROM iv JOIN c ON iv.grid_id = c.grid_id AND iv.mark = c.mark WHERE n >= 2), m AS (SELECT * FROM k WHERE t1 - t0 >= lo AND t1 - t0 < hi) SELECT 'total' AS counter, count(*) AS n FROM iv UNION ALL SELECT 'considered', count(*) FROM iv WHERE mark IN ('click', 'view') UNION ALL SELECT 'enough', count(*) FROM k UNION ALL SELECT 'matching', count(*) FROM m UNION ALL SELECT 'changed', count(*) FROM m WHERE mark <> 'view'")
def a6_counts(spark, sf):
    return stats.label_counts(views.events(spark, sf), "events", "events", "view", ["click", "view"], ["grid_id"], 5, 90, min_count=2)


@query("a10_run_log", f"WITH {SQL_EVENTS}, d AS (SELECT max(t1) - min(t0) AS d FROM iv GROUP BY grid_id) SELECT count(d) AS n, min(d) AS shortest, max(d) AS longest, round(avg(d), 3) AS mean, CAST(sum(d) AS BIGINT) AS total FROM d")
def a10(spark, sf):
    return stats.run_log(stats.grid_durations(views.events(spark, sf))).withColumn("mean", F.round("mean", 3))


@query("b6_round_times", f"WITH {SQL_EVENTS} SELECT grid_id, idx, round_even(t0 / 4.0::DOUBLE, 0) AS t0, round_even(t1 / 4.0::DOUBLE, 0) AS t1, mark FROM iv")
def b6(spark, sf):
    quarter = views.events(spark, sf).withColumns({"t0": F.col("t0") / 4, "t1": F.col("t1") / 4})  # halves and quarters are exact
    return plain(alignment.round_times(quarter, 0))


@query("v3_tier_errors", "SELECT conv_id AS grid_id, 'tier does not exist: absent' AS error FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id")
def v3(spark, sf):
    rows = views.conversations(spark, sf).where("tier_name = 'text' or grid_id % 2 = 0").withColumn("tier_name", F.when((F.col("tier_name") == "role") & (F.col("grid_id") % 2 == 0), "text2").otherwise(F.col("tier_name")))
    both = rows.unionByName(rows.where("grid_id % 2 <> 0").withColumns({"tier_idx": F.lit(5), "tier_name": F.lit("absent")}))
    return validation.tier_errors(both, exist=["text"], unique=["absent"])


@query("v4_invalid_grids", f"WITH {SQL_EVENTS} SELECT DISTINCT grid_id, 'intervals are not consecutive' AS error FROM iv WHERE idx = 3 AND EXISTS (SELECT 1 FROM iv o WHERE o.grid_id = iv.grid_id AND o.idx = 4)")
def v4(spark, sf):
    return validation.invalid_grids(views.events(spark, sf).where("idx <> 3"))


@query("v5_unequal_counts", f"WITH {SQL_EVENTS}, c AS (SELECT grid_id, count(*) AS n_source, count(*) FILTER (mark <> 'signup') AS n_target FROM iv GROUP BY grid_id) SELECT * FROM c WHERE n_source <> n_target")
def v5(spark, sf):
    iv = views.events(spark, sf)
    other = iv.where("mark <> 'signup'").withColumns({"tier_idx": F.lit(1), "tier_name": F.lit("other")})
    return validation.unequal_counts(iv.unionByName(other), "events", "other")


@query("v6_missing_words", f"WITH {SQL_EVENTS} SELECT mark AS word, count(*) AS n FROM iv WHERE mark NOT IN ('', 'click') GROUP BY mark")
def v6(spark, sf):
    words = spark.createDataFrame([("click", ["k"], 1)], "word string, pronunciation array<string>, weight long")
    return validation.missing_words(views.events(spark, sf), words, ["events"])


@query("v7_audio_mismatches", f"WITH {SQL_EVENTS}, g AS (SELECT grid_id, max(t1) AS e FROM iv GROUP BY grid_id) SELECT grid_id, e // 1000000 * 16 + grid_id % 2 AS n_samples, CAST(e // 1000000 * 16 AS BIGINT) AS expected FROM g WHERE grid_id % 2 = 1")
def v7(spark, sf):
    iv = views.events(spark, sf).withColumn("t1", F.floor(F.col("t1") / 1_000_000).cast("double"))
    audio = iv.groupBy("grid_id").agg((F.max("t1").cast("long") * 16 + F.col("grid_id") % 2).alias("n_samples"), F.lit(16).alias("sample_rate"))
    return validation.audio_mismatches(iv, audio)


_POINTS_IN = f"WITH {SQL_EVENTS},{SQL_JITTER}, p AS (SELECT grid_id, t0 AS t FROM ji UNION SELECT grid_id, t1 + 5000000 FROM ji UNION SELECT grid_id, min(t0) - 1000000 FROM ji GROUP BY grid_id)"


@query("j6_enclosing", _POINTS_IN + ", e AS (SELECT grid_id, min(t0) AS lo, max(t1) AS hi, max(idx) AS last FROM iv GROUP BY grid_id) SELECT p.grid_id, p.t, iv.idx, iv.mark, p.t < lo OR p.t >= hi AS clamped FROM p JOIN e ON p.grid_id = e.grid_id JOIN iv ON iv.grid_id = p.grid_id AND (p.t >= iv.t0 AND p.t < iv.t1 OR p.t < lo AND iv.idx = 0 OR p.t >= hi AND iv.idx = last)")
def j6(spark, sf):
    """Timepoints before, in and behind the tiers, in time blocks of a week."""
    iv = views.events(spark, sf)
    other = views.jittered(iv)
    times = other.select("grid_id", "tier_idx", F.explode(F.array("t0", F.col("t1") + 5 * SECOND)).alias("t"))
    early = other.groupBy("grid_id", "tier_idx").agg((F.min("t0") - SECOND).alias("t"))
    found = lookup.enclosing(times.unionByName(early).distinct(), iv, width=7 * 24 * HOUR)
    return found.select("grid_id", "t", "_in.idx", "_in.mark", "_in.clamped")


@query("i6_join_by_duration_blocks", ORACLES["i6_join_by_duration"])
def i6_blocks(spark, sf):
    """The same packing with tiers cut into time blocks of a week."""
    return plain(joining.join_by_duration(views.events(spark, sf), 24 * HOUR, width=7 * 24 * HOUR))


@query("j8_with_audio", f"WITH {SQL_EVENTS} SELECT grid_id, idx, mark, n_samples FROM iv JOIN (SELECT user_id * 2 AS u, count(*) * 100 AS n_samples FROM events GROUP BY user_id) a ON a.u = grid_id")
def j8(spark, sf):
    sound = spark.read.parquet(f"{sf}/events.parquet").groupBy((F.col("user_id") * 2).alias("grid_id")).agg((F.count(F.lit(1)) * 100).alias("n_samples"), F.lit(100).alias("sample_rate"))
    return alignment.with_audio(views.events(spark, sf), sound).select("grid_id", "idx", "mark", "n_samples")


@query("f2_single_tier", "SELECT conv_id AS grid_id, turn AS idx, text AS mark FROM conversations WHERE conv_id % 3 <> 0")
def f2(spark, sf):
    """In every third grid both tiers have the name, so that none is the one."""
    rows = views.conversations(spark, sf)
    named = rows.withColumn("tier_name", F.when(F.col("grid_id") % 3 == 0, "text").otherwise(F.col("tier_name")))
    return selection.single_tier(named, "text").select("grid_id", "idx", "mark")


@query("v8_with_spaces", "SELECT conv_id AS grid_id, turn AS idx, text AS mark FROM conversations WHERE contains(text, ' ') AND trim(text) <> ''")
def v8(spark, sf):
    return dictionary.with_spaces(views.conversations(spark, sf), ["text"]).select("grid_id", "idx", "mark")


@query("v9_creation_errors", "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) / 15.0::DOUBLE AS size, CASE doc_id % 4 WHEN 0 THEN -1.0 WHEN 1 THEN 100.0 WHEN 2 THEN 2.0 END::DOUBLE AS s, CASE doc_id % 4 WHEN 2 THEN 1.0 WHEN 3 THEN 200.0 END::DOUBLE AS e FROM documents) SELECT * FROM (SELECT doc_id AS grid_id, CASE WHEN t = '' THEN 'text is empty' WHEN s < 0 THEN 'start is negative' WHEN s >= size THEN 'start is not before the end of the audio' WHEN e <= coalesce(s, 0) THEN 'end is not behind the start' WHEN e >= size THEN 'end is not before the end of the audio' END AS error FROM d) WHERE error IS NOT NULL")
def v9(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    k = F.col("doc_id") % 4
    rows = docs.select(F.col("doc_id").alias("grid_id"), "text", F.when(k == 0, -1.0).when(k == 1, 100.0).when(k == 2, 2.0).alias("start"), F.when(k == 2, 1.0).when(k == 3, 200.0).alias("end"))
    return creation.creation_errors(rows)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each application; they need no copy of the repository."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    tmp = tempfile.mkdtemp()  # code only; executors fetch the archive from the driver as long as it runs
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    shutil.copytree(root, os.path.join(tmp, "package", root.name), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tmp, root.name), "zip", os.path.join(tmp, "package")))
    _shipped.add(app)
