"""Files of results: clip metadata and metrics as CSV, annotations and timelines as JSON by video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipyard.functions.scalars import rounded

CLIPS = "clip_filename string, source_video string, duration_sec double, track_id int, start_sec double, end_sec double, presence_ratio double, speech_ratio double, talking_ratio double, face_height_ratio double, mean_confidence double, median_bbox string"
METRICS = "clip_id string, type string, method string, speaker_similarity double, rms_db double, crest_factor_db double, spectral_centroid double, spectral_rolloff double, zero_crossing_rate double"
BOXES = "array<struct<time_sec:double,source_time_sec:double,frame:bigint,bbox_xyxy:array<double>,confidence:double,is_talking:boolean>>"
ANNOTATIONS = f"clip_filename string, source_video string, speaker_track_id int, start_sec double, duration_sec double, boxes {BOXES}"


def as_json(numbers: Column) -> Column:
    """An array of numbers as JSON text, with a space behind each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(numbers, lambda x: x.cast("string")), ", "), F.lit("]"))


def clip_records(top: DataFrame) -> DataFrame:
    """Ranked clips as rows of the metadata file: its twelve columns in order, the file under the folder of its video."""
    n = lambda c, digits: rounded(F.col(c) if isinstance(c, str) else c, digits)
    return top.select(
        F.concat_ws("/", "video_id", "clip_filename").alias("clip_filename"), F.col("video_id").alias("source_video"), n(F.col("end") - F.col("start"), 3).alias("duration_sec"), F.col("track_id").cast("int").alias("track_id"), n("start", 3).alias("start_sec"), n("end", 3).alias("end_sec"),
        n("presence", 4).alias("presence_ratio"), n("speech", 4).alias("speech_ratio"), n("talking", 4).alias("talking_ratio"), n("face", 4).alias("face_height_ratio"), n("mean_confidence", 4).alias("mean_confidence"), as_json(F.transform("median_bbox", lambda x: n(x, 1))).alias("median_bbox"),
    )


def annotation_records(a: DataFrame) -> DataFrame:
    """Annotations of clips (operators.clips.annotations) as they are written, digits cut as there."""
    box = lambda b: F.struct(b["time_sec"].alias("time_sec"), rounded(b["source_time_sec"], 3).alias("source_time_sec"), b["frame"].alias("frame"), F.transform(b["bbox_xyxy"], lambda x: rounded(x, 1)).alias("bbox_xyxy"), rounded(b["confidence"], 4).alias("confidence"), b["is_talking"].alias("is_talking"))
    return a.select("video_id", "clip_filename", F.col("video_id").alias("source_video"), F.col("track_id").cast("int").alias("speaker_track_id"), rounded(F.col("start"), 3).alias("start_sec"), rounded(F.col("duration"), 3).alias("duration_sec"), F.transform("boxes", box).alias("boxes"))


def write_csv(rows: DataFrame, path: str, schema: str) -> None:
    """Rows as CSV with a header, with the columns of the schema in its order; quotes are doubled, as readers of CSV expect."""
    names = [c.split()[0] for c in schema.split(", ")]
    rows.select(*names).write.option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)


def write_by_video(rows: DataFrame, path: str) -> None:
    """A folder and one file of JSON lines for each video_id. The rows of a video go to one task, so that its file is one, and a task writes one file after the other."""
    rows.repartition("video_id").sortWithinPartitions("video_id").write.partitionBy("video_id").json(path)


def read_by_video(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_by_video wrote, with video_id."""
    return spark.read.schema(f"{schema}, video_id string").json(path)
