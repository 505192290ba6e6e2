"""Registered queries on keys that hold half of all rows and on intervals of very different lengths, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipyard.operators import clips, intervals, splits, stats, tracking
from clipyard.plans import queries as q
from clipyard.sources.tables import table

QUERIES, SQL = {}, {}
#: Rows of a key that these queries leave to one task: so few that the large video is cut into ranges.
FEW = 500


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def detections(spark: SparkSession, d: str) -> DataFrame:
    """The detections, with all users of even number in one video."""
    return q.detections(spark, d).withColumn("video_id", F.when(F.col("video_id").cast("int") % 2 == 0, "large").otherwise(F.col("video_id")))


def large(sql: str) -> str:
    return sql.replace("CAST(user_id AS VARCHAR) AS video_id", "CASE WHEN user_id % 2 = 0 THEN 'large' ELSE CAST(user_id AS VARCHAR) END AS video_id", 1)


# --- ordered scans ------------------------------------------------------------------------------


@query(f"WITH {large(q.RUNS).replace('86400', '900')} SELECT video_id, track_id, run_id, round(a, 3) AS run_start, round(b, 3) AS run_end, n FROM runs")
def speaking_runs_of_a_large_video(spark: SparkSession, d: str) -> DataFrame:
    rules = clips.Rules(max_gap=900.0, period=3600.0)
    return clips.runs(detections(spark, d), rules, FEW).select("video_id", "track_id", "run_id", F.round("start", 3).alias("run_start"), F.round("end", 3).alias("run_end"), "n")


@query(f"WITH {large(q.MOTION)} SELECT frame, round(motion, 4) AS motion, (EXISTS (SELECT 1 FROM sp WHERE sp.video_id = mo.video_id AND mo.time_sec BETWEEN s - 60 AND e + 60)) AND opening IS NOT NULL AND (motion >= 20 OR opening >= 30) AS talks FROM mo")
def talking_labels_of_a_large_video(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d).drop("is_talking")
    return clips.talking(det, q.speech(det), 60.0, 20.0, 30.0, FEW).select("frame", F.round("motion", 4).alias("motion"), F.col("is_talking").alias("talks"))


@query(large(q.SQL["nearest_detection"]).replace("is_talking THEN f.frame", "event_type = 'error' THEN f.frame"))
def nearest_detection_of_a_large_video(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    return intervals.nearest(det.select("video_id", "frame"), det.where("event_type = 'error'").select("video_id", "frame", "confidence"), ["video_id"], 200, "confidence", FEW).select("frame", "near_frame")


@query(q.SQL["box_stats"].replace("l_extendedprice", "l_discount").replace("l_returnflag", "l_linestatus"))
def box_stats_of_large_groups(spark: SparkSession, d: str) -> DataFrame:
    """Few different values, many rows each: they are counted before they are put in order."""
    b = stats.box_stats(table(spark, d, "lineitem"), ["l_linestatus"], "l_discount", most=3)
    return b.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query(f"WITH {q.CLIPS}, n AS (SELECT *, row_number() OVER (PARTITION BY dialect, environment ORDER BY key) - 1 AS place, count(*) OVER (PARTITION BY dialect, environment) AS n FROM cl) SELECT key, place FROM n")
def places_in_large_groups(spark: SparkSession, d: str) -> DataFrame:
    """Order numbers of clips in eight groups, which is what splits, donor videos and donor clips are drawn by."""
    return splits.numbered(q.clip_rows(spark, d).select("key", "dialect", "environment"), ["dialect", "environment"], ["key"], "place", 20).select("key", "place")


# --- interval joins -----------------------------------------------------------------------------

MIXED = (
    large(q.DET)
    + """,
w AS (SELECT frame, video_id, time_sec AS a, time_sec + pow(3.0, frame % 13) AS b FROM det WHERE event_type = 'click'),
i AS (SELECT video_id, time_sec AS s, time_sec + pow(2.0, frame % 24) AS e FROM det WHERE event_type = 'purchase')"""
)


def windows(det: DataFrame) -> DataFrame:
    """From one second to six days."""
    return det.where("event_type = 'click'").select("frame", "video_id", F.col("time_sec").alias("start"), (F.col("time_sec") + F.pow(F.lit(3.0), (F.col("frame") % 13).cast("double"))).alias("end"))


@query(f"WITH {MIXED} SELECT w.frame, round(coalesce(sum(CASE WHEN s IS NOT NULL THEN least(b, e) - greatest(a, s) END), 0) / (b - a), 6) AS covered FROM w LEFT JOIN i ON i.video_id = w.video_id AND s < b AND e > a GROUP BY w.frame, a, b")
def coverage_of_mixed_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of up to three months, so that a window meets a good part of all of them."""
    det = detections(spark, d)
    speech = det.where("event_type = 'purchase'").select("video_id", F.col("time_sec").alias("s"), (F.col("time_sec") + F.pow(F.lit(2.0), (F.col("frame") % 24).cast("double"))).alias("e"))
    return intervals.dense_coverage(windows(det), speech, ["video_id"], FEW).select("frame", F.round("covered", 6).alias("covered"))


@query(f"WITH {MIXED} SELECT w.frame, count(cut) AS n_cuts FROM w LEFT JOIN cu ON cu.video_id = w.video_id AND a < cut AND cut < b GROUP BY 1")
def cuts_in_mixed_lengths(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    w = windows(det)
    n = intervals.cuts_inside(w, q.cuts(det), ["video_id"], FEW)
    return w.join(n, ["video_id", "start", "end"], "left").select("frame", F.coalesce("n_cuts", F.lit(0)).cast("long").alias("n_cuts"))


# --- suppression and tracks ---------------------------------------------------------------------


@query(large(q.SQL["suppress_overlaps"]).replace("det WHERE is_talking", "det WHERE event_type IN ('click', 'view')"))
def suppress_a_dense_stretch(spark: SparkSession, d: str) -> DataFrame:
    """Windows of half a day to a day and a half after each click or view: those of the large video overlap from first to last."""
    w = detections(spark, d).where("event_type IN ('click', 'view')").select("video_id", "track_id", "frame", F.col("time_sec").alias("start"), (F.col("time_sec") + q.DAY / 2 + F.col("confidence") * q.DAY).alias("end"), "confidence")
    return clips.suppressed(w, [-F.col("confidence"), F.col("start"), F.col("frame")], in_array=FEW, most=FEW)


def tracks(boxes: str, max_gap: int) -> str:
    """The tracker as SQL: one box after another, with the live tracks as a list."""
    inter = "greatest(0, least(s.x2, d.x2) - greatest(s.x1, d.x1)) * greatest(0, least(s.y2, d.y2) - greatest(s.y1, d.y1))"
    areas = "(s.x2 - s.x1) * (s.y2 - s.y1) + (d.x2 - d.x1) * (d.y2 - d.y1)"
    return f"""WITH RECURSIVE {boxes},
d AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY sample_idx, confidence DESC, box_idx) AS k FROM bx),
t AS (SELECT DISTINCT video_id, 0::BIGINT AS k, 0 AS born, []::STRUCT(id INTEGER, last INTEGER, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS live, 0 AS sample_idx, 0 AS box_idx, 0 AS track_id FROM bx
UNION ALL
SELECT video_id, k, CASE WHEN track_id = born THEN born + 1 ELSE born END, list_append(list_filter(live, lambda s: s.id <> track_id), {{'id': track_id, 'last': sample_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}), sample_idx, box_idx, track_id FROM (
  SELECT *, CASE WHEN best.o >= 0.3::DOUBLE THEN best.id ELSE born END AS track_id FROM (
    SELECT d.video_id, d.k, d.sample_idx, d.box_idx, d.x1, d.y1, d.x2, d.y2, t.born, list_filter(t.live, lambda s: d.sample_idx - s.last <= {max_gap}) AS live,
      list_max(list_transform(list_filter(t.live, lambda s: d.sample_idx - s.last <= {max_gap} AND s.last < d.sample_idx), lambda s: {{'o': ({inter}) / (({areas}) - ({inter})), 'id': s.id}})) AS best
    FROM t JOIN d ON d.video_id = t.video_id AND d.k = t.k + 1)))
SELECT video_id, sample_idx, box_idx, track_id FROM t WHERE k > 0"""


@query(tracks(q.DET + ", bx AS (SELECT video_id, CAST(floor(time_sec / 7200) AS INTEGER) AS sample_idx, CAST(frame AS INTEGER) AS box_idx, x1, y1, x1 + 800 AS x2, y1 + 800 AS y2, confidence FROM det)", 6))
def iou_tracks(spark: SparkSession, d: str) -> DataFrame:
    return q.iou_tracks(spark, d)


#: Places on a coarse grid, so that equal overlaps are common; samples without boxes here and there.
GRID = ", bx AS (SELECT video_id, CAST(floor(time_sec / 3000) AS INTEGER) AS sample_idx, CAST(frame AS INTEGER) AS box_idx, floor(x1 / 250) * 250 AS x1, floor(y1 / 250) * 250 AS y1, floor(x1 / 250) * 250 + 600 AS x2, floor(y1 / 250) * 250 + 600 AS y2, confidence FROM det WHERE event_type <> 'error')"


@query(tracks(large(q.DET).replace("user_id % 2", "user_id % 5") + GRID, 2))
def iou_tracks_of_a_large_video(spark: SparkSession, d: str) -> DataFrame:
    """A video of a fifth of all boxes, nearly without gaps, in slices of a hundred samples."""
    det = q.detections(spark, d).where("event_type <> 'error'").withColumn("video_id", F.when(F.col("video_id").cast("int") % 5 == 0, "large").otherwise(F.col("video_id")))
    on = lambda c: F.floor(F.col(c) / 250) * 250.0
    boxes = det.select("video_id", F.floor(F.col("time_sec") / 3000).cast("int").alias("sample_idx"), F.col("frame").cast("int").alias("box_idx"), on("x1").alias("x1"), on("y1").alias("y1"), (on("x1") + 600).alias("x2"), (on("y1") + 600).alias("y2"), "confidence")
    return tracking.iou_tracks(boxes, samples=100, warm=20, most=FEW).select("video_id", "sample_idx", "box_idx", "track_id")
