"""Registered queries: the operators on views of the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipyard.functions import labels
from clipyard.functions import scalars as S
from clipyard.operators import clips, intervals, metadata, splits, stats, tracking
from clipyard.sources import tables
from clipyard.sources.tables import table

DAY = 86400.0
RULES = clips.Rules(max_gap=DAY, min_len=DAY / 2, max_len=2 * DAY, period=3600.0, min_presence=0.1, min_face=0.2, min_speech=0.0005, per_video=5)
METHODS = ["openvoice", "seed_vc", "cosyvoice"]
QUERIES, SQL = {}, {}


def unique() -> str:
    """A name for files of one run."""
    return uuid.uuid4().hex


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- views --------------------------------------------------------------------------------------


def detections(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 1e6
    x1, y1 = (F.col("event_id") % 1000).cast("double"), (F.col("event_id") % 500).cast("double")
    return e.select(
        F.col("user_id").cast("string").alias("video_id"), F.lit(0).alias("track_id"), F.col("event_id").alias("frame"), t.alias("time_sec"), F.col("event_type").isin("click", "view", "purchase").alias("is_talking"), "event_type", "value",
        x1.alias("x1"), y1.alias("y1"), (x1 + 50 + F.col("value")).alias("x2"), (y1 + 80 + F.col("value")).alias("y2"), ((F.col("event_id") % 100) / 100.0).alias("confidence"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("opening"),
    )


def speech(det: DataFrame) -> DataFrame:
    return det.where("event_type = 'purchase'").select("video_id", F.col("time_sec").alias("s"), (F.col("time_sec") + F.col("value") * 60).alias("e"))


def cuts(det: DataFrame) -> DataFrame:
    return det.where("event_type = 'error'").select("video_id", F.col("time_sec").alias("cut"))


def rounded(x: str, digits: int) -> str:
    """SQL of scalars.rounded: DuckDB rounds doubles by way of x * 10^digits, which leaves ties to the last bit."""
    return f"CAST(round(CAST({x} AS DECIMAL(38, 8)), {digits}) AS DOUBLE)"


DET = """det AS (SELECT CAST(user_id AS VARCHAR) AS video_id, 0 AS track_id, event_id AS frame,
 CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 1000000 AS time_sec, event_type IN ('click', 'view', 'purchase') AS is_talking, event_type, value,
 CAST(event_id % 1000 AS DOUBLE) AS x1, CAST(event_id % 500 AS DOUBLE) AS y1, CAST(event_id % 1000 AS DOUBLE) + 50 + value AS x2, CAST(event_id % 500 AS DOUBLE) + 80 + value AS y2,
 CAST(event_id % 100 AS DOUBLE) / 100 AS confidence, CASE WHEN event_id % 7 <> 0 THEN value END AS opening FROM events),
sp AS (SELECT video_id, time_sec AS s, time_sec + value * 60 AS e FROM det WHERE event_type = 'purchase'),
cu AS (SELECT video_id, time_sec AS cut FROM det WHERE event_type = 'error')"""
RUNS = DET + """,
tk AS (SELECT *, lag(time_sec) OVER (PARTITION BY video_id ORDER BY time_sec, frame) AS p FROM det WHERE is_talking),
rr AS (SELECT *, sum(CASE WHEN time_sec - p > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY time_sec, frame ROWS UNBOUNDED PRECEDING) AS run_id FROM tk),
runs AS (SELECT video_id, track_id, CAST(run_id AS BIGINT) AS run_id, min(time_sec) AS a, max(time_sec) + 3600 AS b, count(*) AS n FROM rr GROUP BY ALL)"""
TILES = RUNS + """,
ks AS (SELECT *, unnest(range(0, CAST(floor((b - a - 43200) / 172800) AS BIGINT) + 1)) AS k FROM runs WHERE b - a >= 43200),
tiles AS (SELECT video_id, track_id, run_id, k, a + k * 172800 AS a, least(a + k * 172800 + 172800, b) AS b FROM ks)"""
QUALITY = TILES + f""",
st AS (SELECT w.video_id, w.track_id, w.run_id, w.k, w.a, w.b, count(d.frame) AS n, coalesce(avg(CASE WHEN d.is_talking THEN 1.0::DOUBLE WHEN NOT d.is_talking THEN 0.0 END), 0) AS talking,
  coalesce(quantile_cont(d.y2 - d.y1, 0.5) / 720, 0) AS face, avg(d.confidence) AS mean_confidence, quantile_cont(d.x1, 0.5) AS box_x1
  FROM tiles w LEFT JOIN det d ON d.video_id = w.video_id AND d.time_sec >= w.a AND d.time_sec < w.b GROUP BY ALL),
sc AS (SELECT w.video_id, w.a, sum(greatest(0, least(w.b, e) - greatest(w.a, s))) AS secs FROM tiles w JOIN sp ON sp.video_id = w.video_id AND s < w.b AND e > w.a GROUP BY ALL),
cc AS (SELECT w.video_id, w.a, count(*) AS n_cuts FROM tiles w JOIN cu ON cu.video_id = w.video_id AND w.a < cut AND cut < w.b GROUP BY ALL),
q0 AS (SELECT st.*, n / greatest(1, round_even((st.b - st.a) / 3600, 0)) AS presence, coalesce(secs, 0) / (st.b - st.a) AS speech, coalesce(n_cuts, 0) AS n_cuts
  FROM st LEFT JOIN sc ON sc.video_id = st.video_id AND sc.a = st.a LEFT JOIN cc ON cc.video_id = st.video_id AND cc.a = st.a),
qu AS (SELECT *, CASE WHEN {rounded('presence', 8)} < 0.1 THEN 'presence' WHEN n_cuts > 0 THEN 'cut' WHEN {rounded('face', 8)} < 0.2 THEN 'face' WHEN {rounded('speech', 8)} < 0.0005 THEN 'speech' END AS reject_reason FROM q0)"""
TOP = QUALITY + f""",
tp AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {rounded('talking', 4)} DESC, {rounded('speech', 4)} DESC, {rounded('face', 4)} DESC, {rounded('presence', 4)} DESC, track_id, a) - 1 AS ordinal FROM qu WHERE reject_reason IS NULL),
top AS (SELECT * FROM tp WHERE ordinal < 5)"""


def _quality(spark: SparkSession, d: str, rules: clips.Rules = RULES) -> tuple[DataFrame, DataFrame]:
    det = detections(spark, d)
    return det, clips.quality(det, speech(det), cuts(det), rules)


# --- clips --------------------------------------------------------------------------------------


@query(f"WITH {RUNS} SELECT video_id, track_id, run_id, round(a, 3) AS run_start, round(b, 3) AS run_end, n FROM runs")
def speaking_runs(spark: SparkSession, d: str) -> DataFrame:
    return clips.runs(detections(spark, d), RULES).select("video_id", "track_id", "run_id", F.round("start", 3).alias("run_start"), F.round("end", 3).alias("run_end"), "n")


@query(f"WITH {TILES} SELECT video_id, track_id, run_id, k, round(a, 3) AS start_sec, round(b, 3) AS end_sec FROM tiles")
def clip_windows(spark: SparkSession, d: str) -> DataFrame:
    return clips.tiles(clips.runs(detections(spark, d), RULES), RULES).select("video_id", "track_id", "run_id", F.col("k").cast("long").alias("k"), F.round("start", 3).alias("start_sec"), F.round("end", 3).alias("end_sec"))


@query(f"WITH {QUALITY} SELECT video_id, run_id, k, n, round(presence, 4) AS presence, round(talking, 4) AS talking, round(face, 4) AS face, round(mean_confidence, 6) AS mean_confidence, round(box_x1, 1) AS box_x1, round(speech, 6) AS speech, n_cuts, coalesce(reject_reason, '') AS reject_reason FROM qu")
def window_quality(spark: SparkSession, d: str) -> DataFrame:
    _, q = _quality(spark, d)
    return q.select("video_id", "run_id", F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"), *(F.round(c, 4).alias(c) for c in ("presence", "talking", "face")), F.round("mean_confidence", 6).alias("mean_confidence"), F.round(F.col("median_bbox")[0], 1).alias("box_x1"), F.round("speech", 6).alias("speech"), F.col("n_cuts").cast("long").alias("n_cuts"), F.coalesce("reject_reason", F.lit("")).alias("reject_reason"))


@query(f"WITH {TOP} SELECT video_id, ordinal, round(a, 3) AS start_sec, round(b - a, 3) AS duration_sec, round(talking, 4) AS talking, round(speech, 4) AS speech FROM top")
def top_clips(spark: SparkSession, d: str) -> DataFrame:
    _, q = _quality(spark, d)
    return clips.top(q, RULES).select("video_id", F.col("ordinal").cast("long").alias("ordinal"), F.round("start", 3).alias("start_sec"), F.round(F.col("end") - F.col("start"), 3).alias("duration_sec"), F.round("talking", 4).alias("talking"), F.round("speech", 4).alias("speech"))


@query(f"WITH {TOP} SELECT printf('%03d_%010.3f.mp4', ordinal, {rounded('a', 3)}) AS clip_filename, video_id AS source_video, {rounded('b - a', 3)} AS duration_sec, track_id, {rounded('a', 3)} AS start_sec, {rounded('b', 3)} AS end_sec, {rounded('presence', 4)} AS presence_ratio, {rounded('speech', 4)} AS speech_ratio, {rounded('talking', 4)} AS talking_ratio, {rounded('face', 4)} AS face_height_ratio FROM top")
def clip_metadata(spark: SparkSession, d: str) -> DataFrame:
    _, q = _quality(spark, d)
    t = clips.top(q, RULES)
    return t.select("clip_filename", F.col("video_id").alias("source_video"), S.rounded(F.col("end") - F.col("start"), 3).alias("duration_sec"), "track_id", S.rounded(F.col("start"), 3).alias("start_sec"), S.rounded(F.col("end"), 3).alias("end_sec"), S.rounded(F.col("presence"), 4).alias("presence_ratio"), S.rounded(F.col("speech"), 4).alias("speech_ratio"), S.rounded(F.col("talking"), 4).alias("talking_ratio"), S.rounded(F.col("face"), 4).alias("face_height_ratio"))


@query(f"WITH {TOP} SELECT t.video_id, ordinal, count(*) AS n_boxes, min(d.frame) AS first_frame, max(d.frame) AS last_frame, {rounded(f"min(d.time_sec - {rounded('t.a', 3)})", 3)} AS first_sec FROM top t JOIN det d ON d.video_id = t.video_id AND {rounded('t.a', 3)} <= d.time_sec AND d.time_sec < t.b GROUP BY t.video_id, ordinal")
def clip_annotations(spark: SparkSession, d: str) -> DataFrame:
    det, q = _quality(spark, d)
    a = clips.annotations(clips.top(q, RULES), det, RULES)
    frames = F.transform("boxes", lambda b: b["frame"])
    return a.select("video_id", F.substring("clip_filename", 1, 3).cast("long").alias("ordinal"), F.size("boxes").cast("long").alias("n_boxes"), F.array_min(frames).alias("first_frame"), F.array_max(frames).alias("last_frame"), F.array_min(F.transform("boxes", lambda b: b["time_sec"])).alias("first_sec"))


@query(f"""WITH {QUALITY}, a AS (SELECT video_id, count(*) AS total_samples, count(*) FILTER (is_talking) AS talking_samples FROM det GROUP BY 1), b AS (SELECT video_id, max(b - a) AS longest FROM runs GROUP BY 1),
c AS (SELECT video_id, count(*) AS windows, count(*) FILTER (reject_reason = 'presence') AS presence_rejected, count(*) FILTER (reject_reason = 'cut') AS cut_rejected, count(*) FILTER (reject_reason = 'face') AS face_rejected, count(*) FILTER (reject_reason = 'speech') AS speech_rejected, count(*) FILTER (reject_reason IS NULL) AS ok FROM qu GROUP BY 1)
SELECT a.video_id, total_samples, talking_samples, round(coalesce(longest, 0), 3) AS longest_run, coalesce(windows, 0) AS windows, coalesce(presence_rejected, 0) AS presence_rejected, coalesce(cut_rejected, 0) AS cut_rejected, coalesce(face_rejected, 0) AS face_rejected, coalesce(speech_rejected, 0) AS speech_rejected FROM a LEFT JOIN b USING (video_id) LEFT JOIN c USING (video_id) WHERE coalesce(ok, 0) = 0""")
def clip_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    det, q = _quality(spark, d)
    return clips.diagnostics(det, clips.runs(det, RULES), q).withColumn("longest_run", F.round("longest_run", 3))


@query(f"WITH {DET} SELECT frame, round(coalesce(abs(opening - last_value(opening IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY time_sec, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0), 4) AS motion FROM det")
def mouth_motion(spark: SparkSession, d: str) -> DataFrame:
    return clips.mouth_motion(detections(spark, d)).select("frame", F.round("motion", 4).alias("motion"))


MOTION = f"{DET}, mo AS (SELECT *, coalesce(abs(opening - last_value(opening IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY time_sec, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS motion FROM det)"


@query(f"WITH {MOTION} SELECT frame, (EXISTS (SELECT 1 FROM sp WHERE sp.video_id = mo.video_id AND mo.time_sec BETWEEN s - 600 AND e + 600)) AND opening IS NOT NULL AND (motion >= 20 OR opening >= 30) AS talks FROM mo")
def talking_labels(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d).drop("is_talking")
    return clips.talking(det, speech(det), 600.0, 20.0, 30.0).select("frame", F.col("is_talking").alias("talks"))


@query(f"WITH {DET} SELECT frame, EXISTS (SELECT 1 FROM sp WHERE sp.video_id = det.video_id AND det.time_sec BETWEEN s - 600 AND e + 600) AS in_speech FROM det")
def speech_gate(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    return intervals.inside(det.select("video_id", "frame", "time_sec"), speech(det), ["video_id"], "time_sec", 600.0).select("frame", F.col("inside").alias("in_speech"))


@query(f"WITH {QUALITY} SELECT video_id, run_id, k, round(speech, 6) AS covered FROM qu")
def speech_coverage(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    w = clips.tiles(clips.runs(det, RULES), RULES)
    return intervals.coverage(w, speech(det), ["video_id"], RULES.max_len).select("video_id", "run_id", F.col("k").cast("long").alias("k"), F.round("covered", 6).alias("covered"))


@query(f"WITH {QUALITY} SELECT video_id, run_id, k FROM qu WHERE n_cuts = 0")
def cut_free_windows(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    w = clips.tiles(clips.runs(det, RULES), RULES)
    return intervals.without_cuts(w, cuts(det), ["video_id"]).select("video_id", "run_id", F.col("k").cast("long").alias("k"))


@query(f"""WITH {DET}, pr AS (SELECT f.frame, last_value(CASE WHEN is_talking THEN f.frame END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY f.frame ROWS UNBOUNDED PRECEDING) AS p, first_value(CASE WHEN is_talking THEN f.frame END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY f.frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM det f),
pk AS (SELECT frame, CASE WHEN n IS NULL OR frame - p <= n - frame THEN p ELSE n END AS c FROM pr) SELECT frame, CASE WHEN abs(c - frame) <= 200 THEN c END AS near_frame FROM pk""")
def nearest_detection(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    return intervals.nearest(det.select("video_id", "frame"), det.where("is_talking").select("video_id", "frame", "confidence"), ["video_id"], 200, "confidence").select("frame", "near_frame")


@query(f"""WITH {DET}, w AS (SELECT video_id, track_id, frame, time_sec AS s, time_sec + 43200.0::DOUBLE + confidence * 86400.0::DOUBLE AS e, confidence AS c FROM det WHERE is_talking),
l AS (SELECT video_id, track_id, list([{{'frame': frame, 's': s, 'e': e, 'c': c}}] ORDER BY c DESC, s, frame) AS l FROM w GROUP BY ALL),
k AS (SELECT video_id, track_id, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN a ELSE list_concat(a, x) END)) AS k FROM l)
SELECT video_id, track_id, k.frame AS frame, k.s AS start, k.e AS "end", k.c AS confidence FROM k""")
def suppress_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Windows of half a day to two days after each talking sample overlap; the best by confidence stay."""
    w = detections(spark, d).where("is_talking").select("video_id", "track_id", "frame", F.col("time_sec").alias("start"), (F.col("time_sec") + DAY / 2 + F.col("confidence") * DAY).alias("end"), "confidence")
    return clips.suppressed(w, [-F.col("confidence"), F.col("start"), F.col("frame")])


@query()
def iou_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of events of the same hour of a user are one sample."""
    det = detections(spark, d)
    boxes = det.withColumns({"sample_idx": F.floor(F.col("time_sec") / 7200).cast("int"), "box_idx": F.col("frame").cast("int")})
    wide = boxes.withColumns({"x2": F.col("x1") + 800, "y2": F.col("y1") + 800})
    return tracking.iou_tracks(wide.select("video_id", "sample_idx", "box_idx", "x1", "y1", "x2", "y2", "confidence"), max_gap=6).select("video_id", "sample_idx", "box_idx", "track_id")


@query(f"WITH {DET}, p AS (SELECT *, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1, lag(x2) OVER w AS a2, lag(y2) OVER w AS b2 FROM det WINDOW w AS (PARTITION BY video_id ORDER BY frame)), i AS (SELECT frame, greatest(0, least(x2, a2) - greatest(x1, a1)) * greatest(0, least(y2, b2) - greatest(y1, b1)) AS inter, (x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) AS areas FROM p WHERE a1 IS NOT NULL) SELECT frame, round(inter / (areas - inter), 6) AS overlap FROM i")
def box_iou(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("video_id").orderBy("frame")
    det = detections(spark, d)
    for c in ("x1", "y1", "x2", "y2"):
        det = det.withColumn(f"p{c}", F.lag(c).over(w))
    col = lambda p: [F.col(p + c) for c in ("x1", "y1", "x2", "y2")]
    return det.where("px1 IS NOT NULL").select("frame", F.round(S.iou(col(""), col("p")), 6).alias("overlap"))


@query(f"WITH {DET} SELECT frame, least(greatest(round_even(x2, 0), 0), 640) AS cx2, least(greatest(round_even(y2, 0), 0), 360) AS cy2 FROM det")
def clamp_boxes(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d).select("frame", S.clamp(F.col("x2"), F.lit(640.0)).alias("cx2"), S.clamp(F.col("y2"), F.lit(360.0)).alias("cy2"))


@query("WITH v AS (SELECT o_orderkey AS video_id, CAST(24 + o_orderkey % 7 AS DOUBLE) AS fps, o_custkey % 90 AS n FROM orders), f AS (SELECT video_id, fps, unnest(range(0, n, CAST(greatest(1, round_even(fps / 5, 0)) AS BIGINT))) AS frame FROM v) SELECT video_id, frame, round(frame / fps, 4) AS time_sec FROM f")
def frame_schedule(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), (24 + F.col("o_orderkey") % 7).cast("double").alias("fps"), (F.col("o_custkey") % 90).alias("frame_count"))
    return metadata.frame_schedule(v, 5.0).withColumn("time_sec", F.round("time_sec", 4))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 WHEN user_id % 5 > 0 THEN round(30000.0::DOUBLE / (1000 + user_id % 5), 6) ELSE 25.0 END AS fps FROM events")
def normalize_probe(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, "30000/0").when(F.col("user_id") % 5 > 0, F.concat(F.lit("30000/"), (1000 + F.col("user_id") % 5).cast("string"))).otherwise("25/1")
    return e.select("event_id", F.round(S.rate(text), 6).alias("fps"))


@query("WITH b AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 100 >= 45 THEN 1 ELSE 0 END AS ok FROM events) SELECT CAST(user_id AS VARCHAR) AS video_id, event_id AS frame, CASE WHEN ok = 1 THEN CAST(event_id % 100 AS DOUBLE) / 100 END AS confidence FROM b")
def flatten_detections(spark: SparkSession, d: str) -> DataFrame:
    box = F.struct(F.array("x1", "y1", "x2", "y2").alias("bbox_xyxy"), "confidence")
    t = detections(spark, d).groupBy(F.col("video_id").alias("source_video")).agg(F.sort_array(F.collect_list(F.struct("frame", "time_sec", F.array(box).alias("boxes")))).alias("frames"))
    return tables.flattened(t).select("video_id", "frame", "confidence")


@query(f"WITH {DET} SELECT video_id, count(*) AS n_frames, round(sum(round(time_sec, 4)), 2) AS total_sec FROM det GROUP BY 1")
def nest_detections(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d).withColumns({"sample_idx": F.col("frame"), "box_idx": F.lit(0)})
    n = tables.nested(det)
    return n.select("video_id", F.size("frames").cast("long").alias("n_frames"), F.round(F.aggregate("frames", F.lit(0.0), lambda a, x: a + x["time_sec"]), 2).alias("total_sec"))


@query("WITH t AS (SELECT user_id, 'pts_time:' || CAST(event_id AS VARCHAR) || '.5 x' AS l FROM events) SELECT user_id, CAST(regexp_extract(l, 'pts_time:([0-9.]+)', 1) AS DOUBLE) AS cut_sec FROM t")
def parse_scene_cuts(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "events").groupBy("user_id").agg(F.concat_ws("\n", F.collect_list(F.concat(F.lit("pts_time:"), F.col("event_id").cast("string"), F.lit(".5 x")))).alias("log"))
    return logs.select("user_id", F.explode(F.regexp_extract_all("log", F.lit("pts_time:([0-9.]+)"), F.lit(1))).alias("cut")).select("user_id", F.col("cut").cast("double").alias("cut_sec"))


# --- catalogue ----------------------------------------------------------------------------------


def links(spark: SparkSession, d: str) -> DataFrame:
    """Links and trims of every form, built from orders."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    link = F.when(k % 7 == 0, F.concat(F.lit("https://youtu.be/a"), (k % 50).cast("string"), F.lit("?si=x"))).when(k % 7 == 1, " ").when(k % 7 == 2, F.lit("Total")).otherwise(F.concat(F.lit("https://www.youtube.com/watch?v=b"), (k % 50).cast("string")))
    trim = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.concat(F.lit("1:"), (k % 60).cast("string"), F.lit(":07-2:00:00"))).when(k % 5 == 2, "1:24:7:41").when(k % 5 == 3, "0:10-").otherwise(F.concat((k % 50).cast("string"), F.lit(":16-55:48")))
    return o.select(k.alias("row_order"), link.alias("Link"), trim.alias("Trim"), F.when(k % 3 == 0, "News Talk").otherwise("").alias("Category"), F.lit("Rep Moldova").alias("dialect"), F.lit(0).alias("file_order"))


LINKS = """lk AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'a' || o_orderkey % 50 WHEN o_orderkey % 7 = 2 THEN 'unknown_id' WHEN o_orderkey % 7 <> 1 THEN 'b' || o_orderkey % 50 END AS vid,
 CASE WHEN o_orderkey % 5 = 1 THEN 3600 + 60 * (o_orderkey % 60) + 7 WHEN o_orderkey % 5 = 4 THEN 60 * (o_orderkey % 50) + 16 END AS s, CASE o_orderkey % 5 WHEN 1 THEN 7200 WHEN 4 THEN 3348 END AS e,
 o_orderkey % 5 IN (0, 1, 4) AS ok, CASE WHEN o_orderkey % 3 = 0 THEN 'newstalk' ELSE '' END AS cat FROM orders),
nm AS (SELECT *, 'repmoldova_' || cat || '_' || vid || '_' || CASE WHEN s IS NULL THEN 'full' ELSE s || 's-' || e || 's' END || '.mp4' AS file_name FROM lk WHERE vid IS NOT NULL AND ok)"""


@query(f"WITH {LINKS} SELECT vid, file_name, CAST(any_value(s) AS DOUBLE) AS start_sec, CAST(any_value(e) AS DOUBLE) AS end_sec FROM nm GROUP BY 1, 2")
def download_plan(spark: SparkSession, d: str) -> DataFrame:
    return metadata.download_plan(links(spark, d))[0].drop("Link")


@query(f"WITH {LINKS} SELECT k AS row_order, vid FROM lk WHERE vid IS NOT NULL AND NOT ok")
def download_rejects(spark: SparkSession, d: str) -> DataFrame:
    return metadata.download_plan(links(spark, d))[1].select("row_order", "vid")


@query(f"WITH {LINKS} SELECT k AS row_order, CAST(s AS DOUBLE) AS start_sec, CAST(e AS DOUBLE) AS end_sec, ok FROM lk")
def parse_trim(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).withColumn("t", S.trim_bounds(F.col("Trim"))).select("row_order", F.col("t.start").alias("start_sec"), F.col("t.end").alias("end_sec"), F.col("t.ok").alias("ok"))


@query(f"WITH {LINKS} SELECT k AS row_order, vid FROM lk WHERE vid IS NOT NULL")
def video_ids(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).where("trim(Link) <> ''").select("row_order", S.video_id(F.col("Link")).alias("vid"))


# --- manifest, splits, tasks --------------------------------------------------------------------


def clip_rows(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    vid = F.concat_ws("_", "lang", "source")
    env = F.when(F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2 == 0, "itw").otherwise("studio")
    return doc.select(F.concat(vid, F.lit("__"), F.col("doc_id").cast("string")).alias("key"), "doc_id", vid.alias("video_id"), F.col("lang").alias("dialect"), env.alias("environment"), F.concat(F.lit("audio/"), vid, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("audio_path"))


CLIPS = """cl AS (SELECT lang || '_' || source || '__' || doc_id AS key, doc_id, lang || '_' || source AS video_id, lang AS dialect, CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 2 = 0 THEN 'itw' ELSE 'studio' END AS environment, 'audio/' || lang || '_' || source || '/' || doc_id || '.wav' AS audio_path FROM documents)"""
SPLITS = CLIPS + """,
vs AS (SELECT DISTINCT video_id, dialect, environment FROM cl),
vr AS (SELECT *, row_number() OVER (PARTITION BY dialect, environment ORDER BY md5('1337|' || video_id), video_id) AS rn, count(*) OVER (PARTITION BY dialect, environment) AS n FROM vs),
v2 AS (SELECT video_id, dialect IN ('de', 'es') AS o, dialect, CASE WHEN rn <= floor(0.7::DOUBLE * n) THEN 'train' WHEN rn <= floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n) THEN 'val' ELSE 'test_id' END AS u,
 CASE WHEN rn <= floor(0.1::DOUBLE * n) THEN 'train' WHEN rn <= floor(0.1::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'val' ELSE 'test' END AS f FROM vr),
sl AS (SELECT cl.*, CASE WHEN o THEN 'test_ood_' || cl.dialect ELSE u END AS p1, CASE WHEN o THEN f ELSE u END AS p2 FROM cl JOIN v2 USING (video_id))"""
METHODS_SQL = SPLITS + """,
gr AS (SELECT p1, p2, min(key) AS first_key FROM sl GROUP BY ALL),
me AS (SELECT sl.*, ['openvoice', 'seed_vc', 'cosyvoice'][CAST((row_number() OVER (ORDER BY first_key, key) - 1) % 3 AS INT) + 1] AS assigned_method FROM sl JOIN gr USING (p1, p2))"""


def split_rows(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(clip_rows(spark, d), ["de", "es"], 1337)


def method_rows(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_methods(split_rows(spark, d), METHODS)


@query(f"WITH {CLIPS} SELECT key, CAST(doc_id AS VARCHAR) AS clip_id, 'a/' || video_id || '/' || doc_id || '.wav' AS audio_path, video_id, dialect, source AS environment FROM cl JOIN documents USING (doc_id)")
def manifest_init(spark: SparkSession, d: str) -> DataFrame:
    files = clip_rows(spark, d).select(F.concat(F.lit("clips/"), "video_id", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("path"))
    return metadata.manifest_rows(files, "a").select("key", "clip_id", "audio_path", "video_id", "dialect", "environment")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'rep_moldova' ELSE lang END AS dialect, source AS environment FROM documents")
def parse_folder_name(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, "rep_moldova").otherwise(F.col("lang")), F.lit("_"), "source", F.lit("_x_full"))
    return table(spark, d, "documents").withColumn("p", metadata.folder_parts(name)).select("doc_id", "p.dialect", "p.environment")


@query(f"WITH {SPLITS} SELECT key, p1, p2 FROM sl")
def assign_splits(spark: SparkSession, d: str) -> DataFrame:
    return split_rows(spark, d).select("key", "p1", "p2")


@query(f"WITH {METHODS_SQL} SELECT key, assigned_method FROM me")
def assign_methods(spark: SparkSession, d: str) -> DataFrame:
    return method_rows(spark, d).select("key", "assigned_method")


DONORS = METHODS_SQL + """,
dv AS (SELECT p1, p2, video_id, row_number() OVER (PARTITION BY p1, p2 ORDER BY video_id) - 1 AS idx, count(*) OVER (PARTITION BY p1, p2) AS n, count(*) AS n_clips FROM me GROUP BY p1, p2, video_id),
dr AS (SELECT me.*, dv.idx AS own, n, CASE WHEN n > 1 THEN CAST('0x' || substr(md5('1337|' || key), 1, 8) AS BIGINT) % (n - 1) END AS r FROM me JOIN dv USING (p1, p2, video_id)),
dn AS (SELECT dr.*, dv.video_id AS donor_video_id, dv.n_clips FROM dr LEFT JOIN dv ON dv.p1 = dr.p1 AND dv.p2 = dr.p2 AND dv.idx = r + CASE WHEN r >= own THEN 1 ELSE 0 END)"""
#: The places that a clip draws among its donor's clips: each among those left, past the ones before it.
PLACES = DONORS + """,
pl AS (SELECT video_id, audio_path, row_number() OVER (PARTITION BY video_id ORDER BY audio_path, key) - 1 AS place FROM me),
h AS (SELECT key, donor_video_id, n_clips AS c, CASE WHEN n_clips > 0 THEN CAST('0x' || substr(md5('1337|' || key || '|0'), 1, 8) AS BIGINT) % n_clips END AS a0, CASE WHEN n_clips > 1 THEN CAST('0x' || substr(md5('1337|' || key || '|1'), 1, 8) AS BIGINT) % (n_clips - 1) END AS r1, CASE WHEN n_clips > 2 THEN CAST('0x' || substr(md5('1337|' || key || '|2'), 1, 8) AS BIGINT) % (n_clips - 2) END AS r2 FROM dn),
h1 AS (SELECT *, r1 + CASE WHEN r1 >= a0 THEN 1 ELSE 0 END AS a1 FROM h),
h2 AS (SELECT *, r2 + CASE WHEN r2 >= least(a0, a1) THEN 1 ELSE 0 END AS b2 FROM h1),
h3 AS (SELECT *, b2 + CASE WHEN b2 >= greatest(a0, a1) THEN 1 ELSE 0 END AS a2 FROM h2),
ho AS (SELECT key, donor_video_id, unnest([{'t': 0, 'place': a0}, {'t': 1, 'place': a1}, {'t': 2, 'place': a2}], recursive := true) FROM h3)"""


@query(f"WITH {PLACES} SELECT ho.key, ho.donor_video_id, coalesce(string_agg(audio_path, ',' ORDER BY t), '') AS donors FROM ho LEFT JOIN pl ON pl.video_id = ho.donor_video_id AND pl.place = ho.place GROUP BY ALL")
def assign_donors(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_donors(split_rows(spark, d), 1337).select("key", "donor_video_id", F.array_join("donor_audio_paths", ",").alias("donors"))


def faked(spark: SparkSession, d: str) -> DataFrame:
    return method_rows(spark, d).withColumn("faked_audio_path", F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("fake/"), "audio_path")))


FAKED = METHODS_SQL + ", fk AS (SELECT *, CASE WHEN doc_id % 4 <> 0 THEN 'fake/' || audio_path END AS faked_audio_path FROM me), sm AS (SELECT key, video_id, dialect, environment, p1, p2, key || '__real' AS sample_id, 'real' AS type, audio_path AS path, NULL AS method FROM fk UNION ALL SELECT key, video_id, dialect, environment, p1, p2, key || '__fake_' || assigned_method, 'fake', faked_audio_path, assigned_method FROM fk WHERE faked_audio_path IS NOT NULL)"


@query(f"WITH {FAKED} SELECT sample_id, key, type, path FROM sm")
def sample_metadata(spark: SparkSession, d: str) -> DataFrame:
    return metadata.samples(faked(spark, d)).select("sample_id", "key", "type", "path")


@query(f"WITH {FAKED} SELECT sample_id, CASE WHEN type = 'real' THEN 0 ELSE 1 END AS label, coalesce(method, 'none') AS method, p1, p2 FROM sm")
def flatten_metadata(spark: SparkSession, d: str) -> DataFrame:
    return metadata.flat(metadata.samples(faked(spark, d))).select("sample_id", "label", "method", "p1", "p2")


@query(f"WITH {METHODS_SQL} SELECT key, 'out/' || video_id || '/' || doc_id || '.wav' AS out_path FROM me WHERE assigned_method = 'seed_vc'")
def synthesis_tasks(spark: SparkSession, d: str) -> DataFrame:
    return method_rows(spark, d).where("assigned_method = 'seed_vc'").select("key", F.concat_ws("/", F.lit("out"), "video_id", F.element_at(F.split("audio_path", "/"), -1)).alias("out_path"))


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id % 3 <> 1").select(F.concat(F.lit("audio/"), "lang", F.lit("_"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"), F.when(F.col("doc_id") % 10 == 0, 0).otherwise(F.col("n_chars")).cast("long").alias("length"))


@query(f"WITH {CLIPS} SELECT key FROM cl WHERE doc_id % 3 = 1 OR doc_id % 10 = 0")
def pending_tasks(spark: SparkSession, d: str) -> DataFrame:
    return metadata.pending(clip_rows(spark, d).withColumnRenamed("audio_path", "path"), files(spark, d)).select("key")


@query(f"WITH {CLIPS} SELECT key FROM cl WHERE doc_id % 3 <> 1 AND doc_id % 10 <> 0")
def existing_samples(spark: SparkSession, d: str) -> DataFrame:
    return clip_rows(spark, d).withColumnRenamed("audio_path", "path").join(files(spark, d).where("length > 0"), "path", "left_semi").select("key")


@query(f"WITH {CLIPS} SELECT key, CASE WHEN doc_id % 3 <> 1 THEN 'new/' || doc_id || '/' || doc_id % 2 ELSE audio_path END AS audio_path FROM cl")
def merge_results(spark: SparkSession, d: str) -> DataFrame:
    """Some keys have two results, of which the later one counts."""
    c = clip_rows(spark, d)
    turns = F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 2).cast("int")))
    new = c.where("doc_id % 3 <> 1").select("key", "doc_id", turns.alias("turn")).select("key", "turn", F.concat_ws("/", F.lit("new"), F.col("doc_id").cast("string"), F.col("turn").cast("string")).alias("audio_path"))
    return metadata.merge(c, new, "key", "audio_path", "turn").select("key", "audio_path")


@query(f"WITH {CLIPS}, t AS (SELECT environment, doc_id % 3 <> 1 AND doc_id % 10 <> 0 AS old, doc_id % 7 > 2 AS new FROM cl) SELECT environment, count(*) AS total, count(*) FILTER (old) AS resumed, count(*) FILTER (NOT old AND new) AS completed, count(*) FILTER (NOT old AND NOT new) AS failed FROM t GROUP BY 1")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    c = clip_rows(spark, d).withColumnRenamed("audio_path", "path")
    after = c.where("doc_id % 7 > 2").select("path", F.lit(1).alias("length"))
    return metadata.batch_summary(c, files(spark, d), after, ["environment"])


@query("SELECT page_id, 'p' || page_id AS rel FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, '../c/p' || page_id FROM pages WHERE page_id % 2 = 1")
def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "/a/b/p").otherwise("/a/c/p"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", S.relative(path, "/a/b").alias("rel"))


@query(f"WITH {CLIPS} SELECT doc_id % 100 || '.wav' AS dest, count(*) AS n FROM cl GROUP BY 1 HAVING count(*) > 1")
def audio_destinations(spark: SparkSession, d: str) -> DataFrame:
    return clip_rows(spark, d).groupBy(F.concat((F.col("doc_id") % 100).cast("string"), F.lit(".wav")).alias("dest")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {CLIPS} SELECT 'audio/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.tmp' ELSE '.wav' END AS path FROM cl WHERE doc_id % 5 <> 0")
def publishable_files(spark: SparkSession, d: str) -> DataFrame:
    return tables.publishable(clip_rows(spark, d).select(F.concat(F.lit("audio/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".tmp").otherwise(".wav")).alias("path")))


@query("""WITH c AS (SELECT * FROM (VALUES (0, 'Rep. Moldova', 'Moldova', 'Rep. Moldova', 'In-the-Wild'), (1, 'Moldova', 'Moldova', 'Moldova', 'Studio'), (2, 'Maramureș', 'Maramureș', 'Maramureș', 'In-the-Wild'), (3, 'Elsewhere_q', 'Elsewhere_q', 'Other', 'Studio'), (4, 'Ardelean_x', 'Ardelean_x', 'Transilvania', 'Studio'), (5, 'Oltenia', 'Oltenia', 'oltenia', 'Studio'),
(6, 'Banat_1', 'Banat_1', 'banat', 'Studio'), (7, 'Dobrogea_itw', 'Dobrogea_itw', 'dobrogea', 'In-the-Wild'), (8, 'Moldova', 'Moldova', 'Moldova', 'Car'), (9, 'Olt', 'Olt', 'Olt', 'In-the-Wild')) t(k, dialect, first_match, of_sound, environment)) SELECT doc_id, dialect, first_match, of_sound, environment FROM documents JOIN c ON k = doc_id % 10""")
def normalize_labels(spark: SparkSession, d: str) -> DataFrame:
    """Names by field, or else by video id, under both sets of rules."""
    k = (F.col("doc_id") % 10).cast("int") + 1
    of = lambda *values: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), k)
    vid = of("REP_moldova_itw_x", "moldova_studio_y", "maramures_interview_z", "elsewhere_q", "ardelean_x", "oltenia_2", "banat_1", "dobrogea_itw", "x", "y")
    field = of(None, "", None, None, None, None, None, None, "MOLDOVA", "Olt")
    env = of(None, None, "", None, None, None, None, None, "cAR", "Interview")
    return table(spark, d, "documents").select("doc_id", labels.dialect(field, vid).alias("dialect"), labels.dialect(field, vid, True).alias("first_match"), labels.dialect_of_sound(field, vid).alias("of_sound"), labels.environment(env, vid).alias("environment"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def sample_head(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(25)


# --- statistics ---------------------------------------------------------------------------------


@query(f"WITH {METHODS_SQL} SELECT assigned_method AS method, coalesce(dialect, 'all') AS dialect, coalesce(environment, 'all') AS environment, count(*) AS n FROM me GROUP BY GROUPING SETS ((assigned_method), (assigned_method, dialect), (assigned_method, environment))")
def method_counts(spark: SparkSession, d: str) -> DataFrame:
    m = method_rows(spark, d).withColumnRenamed("assigned_method", "method")
    g = m.groupingSets([["method"], ["method", "dialect"], ["method", "environment"]], "method", "dialect", "environment").agg(F.count("*").alias("n"))
    return g.select("method", F.coalesce("dialect", F.lit("all")).alias("dialect"), F.coalesce("environment", F.lit("all")).alias("environment"), "n")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity) / 3600, 6) AS hours FROM lineitem GROUP BY 1, 2")
def hours_by_dialect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity") / 3600, 6).alias("hours"))


@query("SELECT count(*) AS clips, round(sum(l_quantity) / 3600, 4) AS hours, round(avg(l_quantity), 6) AS mean_sec, round(stddev_samp(l_quantity), 6) AS sd_sec, count(*) FILTER (l_quantity < 2) AS broken FROM lineitem")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").agg(F.count("*").alias("clips"), F.round(F.sum(q) / 3600, 4).alias("hours"), F.round(F.avg(q), 6).alias("mean_sec"), F.round(F.stddev_samp(q), 6).alias("sd_sec"), F.count_if(q < 2).alias("broken"))


@query(f"WITH {SPLITS} SELECT dialect, count(*) FILTER (p2 = 'train') AS train, count(*) FILTER (p2 = 'val') AS val, count(*) FILTER (p2 = 'test') AS test, count(*) AS total FROM sl WHERE p2 IN ('train', 'val', 'test') GROUP BY 1")
def split_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return stats.crosstab(split_rows(spark, d), "dialect", "p2", ["train", "val", "test"])


@query(f"WITH {METHODS_SQL} SELECT assigned_method, dialect || '_' || environment AS cell, count(*) AS n FROM me GROUP BY ALL")
def method_env_matrix(spark: SparkSession, d: str) -> DataFrame:
    return method_rows(spark, d).groupBy("assigned_method", F.concat_ws("_", "dialect", "environment").alias("cell")).agg(F.count("*").alias("n"))


@query(f"WITH {DONORS} SELECT dialect, split_part(donor_video_id, '_', 1) AS donor_dialect, count(*) AS n FROM dn WHERE donor_video_id IS NOT NULL GROUP BY ALL")
def dialect_transfer(spark: SparkSession, d: str) -> DataFrame:
    x = splits.assign_donors(split_rows(spark, d), 1337).where("donor_video_id IS NOT NULL")
    return x.groupBy("dialect", F.get(F.split("donor_video_id", "_"), 0).alias("donor_dialect")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1) SELECT l.l_returnflag, round(q1, 4) AS q1, round(m, 4) AS median, round(q3, 4) AS q3, min(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_lo, max(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_hi, count(*) FILTER (l_extendedprice NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM lineitem l JOIN s USING (l_returnflag) GROUP BY ALL")
def box_stats(spark: SparkSession, d: str) -> DataFrame:
    b = stats.box_stats(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return b.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("WITH s AS (SELECT l_returnflag AS g, count(*) AS n, stddev_samp(l_quantity) * pow(count(*), -0.2::DOUBLE) AS h, min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem GROUP BY 1), v AS (SELECT l_returnflag AS g, l_quantity AS v, count(*) AS m FROM lineitem GROUP BY ALL), i AS (SELECT *, unnest(range(0, 200)) AS i FROM s) SELECT i.g AS l_returnflag, CAST(i AS INT) AS i, round(sum(m * exp(-pow((a - 3 * h + i * (b - a + 6 * h) / 199 - v) / h, 2) / 2)) / any_value(n) / any_value(h) / sqrt(2 * pi()), 8) AS density FROM i JOIN v ON v.g = i.g GROUP BY i.g, i.i")
def density_curve(spark: SparkSession, d: str) -> DataFrame:
    return stats.density(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", 1.0).select("l_returnflag", "i", F.round("density", 8).alias("density"))


@query(f"WITH {FAKED} SELECT count(DISTINCT key) AS keys, count(*) FILTER (type = 'real') AS real_rows, count(*) FILTER (type = 'fake') AS fake_rows, count(*) AS total FROM sm")
def build_summary(spark: SparkSession, d: str) -> DataFrame:
    s = metadata.samples(faked(spark, d))
    return s.agg(F.count_distinct("key").alias("keys"), F.count_if(F.col("type") == "real").alias("real_rows"), F.count_if(F.col("type") == "fake").alias("fake_rows"), F.count("*").alias("total"))


@query("SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed FROM events")
def job_summary(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    return table(spark, d, "events").agg(F.count("*").alias("total"), F.count_if(~bad).alias("success"), F.count_if(bad).alias("failed"))


# --- vectors and waves --------------------------------------------------------------------------


@query("WITH u AS (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) SELECT label, CAST(pos AS INT) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM u GROUP BY ALL")
def donor_mean_embedding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


COSINE = "WITH f AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY 1) SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, e), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE)))) * sqrt(list_sum(list_transform(e, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE))))), 6) AS similarity FROM embeddings JOIN f USING (label)"


@query(COSINE)
def donor_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("first")), 6).alias("similarity"))


@query("WITH w AS (SELECT vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS e FROM embeddings), r AS (SELECT vec_id, sqrt(list_sum(list_transform(e, lambda z: z * z)) / len(e)) AS r, list_max(list_transform(e, lambda z: abs(z))) AS p FROM w) SELECT vec_id, round(20 * log10(r + 1e-9), 4) AS rms_db, round(20 * log10((p + 1e-9) / (r + 1e-9)), 4) AS crest_db FROM r")
def loudness_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = F.transform("embedding", lambda z: z.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(S.loudness_db(e), 4).alias("rms_db"), F.round(S.crest_db(e), 4).alias("crest_db"))


@query("WITH w AS (SELECT vec_id, unnest(range(0, CAST(greatest(1, ceil((len(embedding) - 8) / 24.0)) AS BIGINT))) AS k, embedding AS e FROM embeddings) SELECT vec_id, CAST(k AS INT) AS k, len(e[k * 24 + 1 : k * 24 + 32]) AS n FROM w")
def overlap_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 32 samples, 8 of them shared with the one before."""
    n = F.greatest(F.lit(1), F.ceil((F.size("embedding") - 8) / 24.0)).cast("int")
    w = table(spark, d, "embeddings").withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    return w.select("vec_id", "k", F.size(F.slice("embedding", F.col("k") * 24 + 1, F.lit(32))).cast("long").alias("n"))


@query("WITH w AS (SELECT label, flatten(list(embedding ORDER BY vec_id))[1:400] AS e FROM embeddings GROUP BY 1) SELECT label, len(e) AS n, round(list_sum(list_transform(e, lambda z: CAST(z AS DOUBLE))), 5) AS total FROM w")
def donor_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Clips of a donor in order, cut at 400 samples; only as many clips as that needs are gathered."""
    from pyspark.sql import Window

    e = table(spark, d, "embeddings").withColumn("before", F.sum(F.size("embedding")).over(Window.partitionBy("label").orderBy("vec_id")) - F.size("embedding")).where("before < 400")
    g = e.groupBy("label").agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])), 1, 400).alias("e"))
    return g.select("label", F.size("e").cast("long").alias("n"), F.round(S.sum_of(F.transform("e", lambda z: z.cast("double"))), 5).alias("total"))


@query("SELECT vec_id, round(CAST(embedding[57] AS DOUBLE), 6) AS first_sample, round(CAST(embedding[64] AS DOUBLE), 6) AS last_sample, round(CAST(embedding[64] AS DOUBLE), 6) AS first_of_one FROM embeddings")
def crossfade_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Over eight samples, and over one, which is then the first chunk's last."""
    e = F.transform("embedding", lambda z: z.cast("double"))
    x = table(spark, d, "embeddings").withColumns({"c": S.crossfade(e, e, 8), "one": S.crossfade(e, e, 1)})
    return x.select("vec_id", F.round(F.col("c")[0], 6).alias("first_sample"), F.round(F.element_at("c", -1), 6).alias("last_sample"), F.round(F.col("one")[0], 6).alias("first_of_one"))
