"""Plans, manifests, samples and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipyard.functions import labels
from clipyard.functions.scalars import trim_bounds, video_id


def download_plan(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(planned, rejected) of catalogue rows (Link, Category, Trim, dialect, file_order, row_order). Blank links go; a blank category stays blank, and is unknown only where its file has no such column; an output name is planned once, by its first row."""
    squeezed = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    rows = links.where(F.trim("Link") != "").withColumns({"vid": video_id(F.trim("Link")), "t": trim_bounds(F.col("Trim"))})
    suffix = F.when(F.col("t.start").isNull(), "full").otherwise(F.concat(F.col("t.start").cast("long").cast("string"), F.lit("s-"), F.col("t.end").cast("long").cast("string"), F.lit("s")))
    name = F.concat_ws("_", squeezed(F.col("dialect")), squeezed(F.coalesce("Category", F.lit("Unknown"))), F.coalesce("vid", F.lit("None")), suffix)
    good = rows.where("t.ok").withColumn("file_name", F.concat(name, F.lit(".mp4")))
    first = F.row_number().over(Window.partitionBy("file_name").orderBy("file_order", "row_order")) == 1
    plan = good.withColumn("first_", first).where("first_").select("Link", "vid", "file_name", F.col("t.start").alias("start_sec"), F.col("t.end").alias("end_sec"))
    bad = rows.where("NOT t.ok").select("Link", "vid", F.concat(F.lit("invalid trim: "), "Trim").alias("reason"), "file_order", "row_order")
    return plan, bad


def folder_parts(folder: Column) -> Column:
    """struct(dialect, environment) of dialect_environment_rest, where rep_moldova is one dialect."""
    p = F.split(folder, "_")
    two = (F.get(p, 0) == "rep") & (F.get(p, 1) == "moldova")
    return F.struct(F.when(two, "rep_moldova").otherwise(F.get(p, 0)).alias("dialect"), F.when(two, F.get(p, 2)).otherwise(F.get(p, 1)).alias("environment"))


def manifest_rows(files: DataFrame, audio_root: str) -> DataFrame:
    """Manifest entries of clip files (path .../folder/stem.ext)."""
    folder, stem = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    p = folder_parts(folder)
    return files.select(F.concat(folder, F.lit("__"), stem).alias("key"), stem.alias("clip_id"), F.col("path").alias("video_path"), F.concat(F.lit(audio_root), F.lit("/"), folder, F.lit("/"), stem, F.lit(".wav")).alias("audio_path"), folder.alias("video_id"), p["dialect"].alias("dialect"), p["environment"].alias("environment"))


def audio_destination(video: Column, stem: Column, nested: bool) -> Column:
    """Where extracted audio goes: a folder per video, or flat, where stems of several videos may collide."""
    return F.concat(video, F.lit("/"), stem, F.lit(".wav")) if nested else F.concat(stem, F.lit(".wav"))


def collisions(dest: DataFrame) -> DataFrame:
    """Destinations (dest) of more than one row, and of how many."""
    return dest.groupBy("dest").agg(F.count("*").alias("n")).where("n > 1")


def donor_paths(manipulation: Column) -> Column:
    """donor_audio_paths, or else the older donor_clips."""
    none = F.array().cast("array<string>")
    return F.when(F.size(F.coalesce(manipulation["donor_audio_paths"], none)) > 0, manipulation["donor_audio_paths"]).otherwise(F.coalesce(manipulation["donor_clips"], none))


def manifest_frame(entries: DataFrame) -> DataFrame:
    """One row per manifest entry, names in place of labels: dialect and environment from their field, or else from the video id; num_donors by donor_paths."""
    m, vid = F.col("audio_manipulation"), F.coalesce("video_id", "entry_key")
    return entries.select(
        F.col("entry_key").alias("clip_id"), F.coalesce("video_id", F.lit("unknown")).alias("video_id"), labels.dialect(F.col("dialect"), vid).alias("dialect"), labels.environment(F.col("environment"), vid).alias("environment"),
        *(labels.split(F.col("splits")[c]).alias(c) for c in ("protocol_1_ood", "protocol_2_fewshot")), labels.method(m["assigned_method"]).alias("audio_method"), F.size(donor_paths(m)).alias("num_donors"),
    )


def frame_schedule(videos: DataFrame, sample_fps: float) -> DataFrame:
    """Frames to look at, and their times: every max(1, round(fps / sample_fps))-th."""
    step = F.greatest(F.lit(1), F.bround(F.col("fps") / sample_fps)).cast("long")
    v = videos.where("frame_count > 0").withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frame_count") - 1, step)))
    return v.select("video_id", "frame", (F.col("frame") / F.col("fps")).alias("time_sec"))


def samples(m: DataFrame) -> DataFrame:
    """One row for the real audio of each entry and one for its fake, where they have a path; a single pass."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    real = F.struct(F.concat("key", F.lit("__real")).alias("sample_id"), F.lit("real").alias("type"), F.col("audio_path").alias("path"), F.lit(None).cast("string").alias("method"), (~blank("audio_path")).alias("ok"))
    fake = F.struct(F.concat("key", F.lit("__fake_"), "assigned_method").alias("sample_id"), F.lit("fake").alias("type"), F.col("faked_audio_path").alias("path"), F.col("assigned_method").alias("method"), (~blank("faked_audio_path") & ~blank("assigned_method")).alias("ok"))
    return m.withColumn("s", F.explode(F.filter(F.array(real, fake), lambda x: x["ok"]))).select("key", "video_id", "dialect", "environment", "p1", "p2", "s.sample_id", "s.type", "s.path", "s.method")


def flat(s: DataFrame) -> DataFrame:
    text = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other)).alias(c)
    return s.select("sample_id", "key", "video_id", "path", "dialect", "environment", text("type", "unknown"), F.when(F.col("type") == "real", 0).otherwise(1).alias("label"), text("method", "none"), text("p1", "unassigned"), text("p2", "unassigned"))


def missing(s: DataFrame, files: DataFrame) -> DataFrame:
    """type, n and n_missing of samples: those whose path is not among the non-empty files."""
    found = files.where("length > 0").select("path", F.lit(True).alias("there_")).distinct()
    return s.join(found, "path", "left").groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("there_").isNull()).alias("n_missing"))


def pending(tasks: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Tasks whose output (path) is not among the non-empty files."""
    return tasks.join(done.where("length > 0").select(key), key, "left_anti")


def merge(old: DataFrame, new: DataFrame, key: str, column: str, order: str | None = None) -> DataFrame:
    """old with column taken from new where new has the key. Of several new rows of one key the last by `order` counts (without an order, that of the largest value), so no row of old is doubled."""
    last = new.groupBy(key).agg((F.max_by(column, order) if order else F.max(column)).alias("new_"))
    return old.join(last, key, "left").withColumn(column, F.coalesce("new_", column)).drop("new_")


def batch_summary(tasks: DataFrame, before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """What a batch did with its tasks (path of the output), by group: total; resumed (the output was there before it), completed by the batch itself, and failed."""
    there = lambda files, name: files.where("length > 0").select("path", F.lit(True).alias(name)).distinct()
    t = tasks.join(there(before, "before_"), "path", "left").join(there(after, "after_"), "path", "left")
    old, new = F.col("before_").isNotNull(), F.col("after_").isNotNull()
    return t.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(old).alias("resumed"), F.count_if(~old & new).alias("completed"), F.count_if(~old & ~new).alias("failed"))
