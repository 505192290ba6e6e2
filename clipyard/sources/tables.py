"""Reading tables and files, and publishing results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTIONS = "source_video string, source_fps double, source_frame_count bigint, sample_fps double, confidence_threshold double, frames array<struct<frame:bigint,time_sec:double,boxes:array<struct<bbox_xyxy:array<double>,confidence:double>>>>"
MANIFEST = "map<string,struct<key:string,clip_id:string,video_path:string,audio_path:string,video_id:string,dialect:string,environment:string,splits:struct<protocol_1_ood:string,protocol_2_fewshot:string>,audio_manipulation:struct<assigned_method:string,donor_video_id:string,donor_audio_paths:array<string>,donor_clips:array<string>,faked_audio_path:string>>>"
IGNORED = (r"(^|/)\.cache/", r"\.tmp$", r"\.pyc$", r"(^|/)__pycache__/", r"(^|/)\.git/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return path or tempfile.mkdtemp(prefix="spark-clipyard-")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def catalogue(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Link catalogues by path. dialect is that of the file's own column Dialect, or else the one given for the file. Columns that a file lacks are null, blank values are empty text. file_order and row_order give the order of rows."""
    out = None
    for order, (path, dialect) in enumerate(files.items()):
        names = spark.read.option("header", True).csv(path).columns
        one = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in names)).csv(path)
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))  # by block of the file, however blocks are packed in tasks
        one = one.withColumns({"file_order": F.lit(order), "row_order": place}).na.fill("", names)
        one = one.withColumn("dialect_", F.coalesce(F.col("Dialect"), F.lit(dialect)) if "Dialect" in names else F.lit(dialect))
        one = one.drop("Dialect").withColumnRenamed("dialect_", "dialect")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def timelines(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(DETECTIONS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "detections.json").json(root)


def flattened(timelines_: DataFrame, threshold: float = 0.45) -> DataFrame:
    """One row per box over the threshold; frames without keep one row, since they advance sample_idx."""
    f = timelines_.select(F.col("source_video").alias("video_id"), F.posexplode_outer("frames").alias("sample_idx", "f"))
    kept = F.filter("f.boxes", lambda b: b["confidence"] >= threshold)
    b = f.select("video_id", "sample_idx", "f.frame", "f.time_sec", F.posexplode_outer(kept).alias("box_idx", "b"))
    return b.select("video_id", "sample_idx", "box_idx", "frame", "time_sec", *(F.get("b.bbox_xyxy", i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), F.col("b.confidence").alias("confidence"))


def nested(d: DataFrame) -> DataFrame:
    """Boxes to one timeline per video; boxes to 2 decimals, times to 4, confidence to 5."""
    box = F.struct("box_idx", F.array(*(F.round(c, 2) for c in ("x1", "y1", "x2", "y2"))).alias("bbox_xyxy"), F.round("confidence", 5).alias("confidence"))
    frames = d.groupBy("video_id", "sample_idx", "frame", "time_sec").agg(F.array_sort(F.collect_list(F.when(F.col("box_idx").isNotNull(), box))).alias("b"))
    frame = F.struct("sample_idx", "frame", F.round("time_sec", 4).alias("time_sec"), F.transform("b", lambda x: F.struct(x["bbox_xyxy"].alias("bbox_xyxy"), x["confidence"].alias("confidence"))).alias("boxes"))
    return frames.groupBy("video_id").agg(F.array_sort(F.collect_list(frame)).alias("f")).select("video_id", F.transform("f", lambda x: F.struct(x["frame"].alias("frame"), x["time_sec"].alias("time_sec"), x["boxes"].alias("boxes"))).alias("frames"))


def manifest(texts: DataFrame) -> DataFrame:
    """One row per entry of keyed JSON manifests, from rows with the whole text in `value`."""
    return texts.select(F.explode(F.from_json("value", MANIFEST)).alias("entry_key", "e")).select("entry_key", "e.*")


def large_manifest(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The same rows from files of keyed JSON objects (one, or several one after another), however large: a file is read by all tasks.

    Spark reads the files in pieces that end with a closing brace, in splits of its own. Whether a piece begins inside a
    string, and at which depth, depends on all before it, but only by sums: of the quotes, then of the braces outside
    strings. Two ordered scans by file carry them across, a third counts the entries that ended before, and the pieces
    of an entry, which come to the size of one entry, are put together again.
    """
    from clipyard.operators.scans import Scan, ordered

    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    order = ["block", "id"]
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # without escaped characters
    o = ordered(scratch(pieces.withColumn("quotes", F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))), "pieces"), ["file"], order, most)
    o = o.scan(quotes_before=Scan("sum", F.col("quotes"), own=False))
    inside = F.col("quotes_before") % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), bare), r'(?s)"[^"]*("|$)', "")
    ends_inside = (F.col("quotes_before") + F.col("quotes")) % 2 == 1
    o = o.with_columns(opened=F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit(""))), closed=F.when(ends_inside, 0).otherwise(1))
    o = o.scan(depth=Scan("sum", F.col("opened") - F.col("closed")))
    o = o.with_columns(ended=F.when((F.col("closed") == 1) & (F.col("depth") == 1), 1).otherwise(0)).scan(entry=Scan("sum", F.col("ended"), own=False))
    parts = o.result().groupBy("file", "entry").agg(F.max("ended").alias("whole"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "value"))), lambda x: x["value"]), "}").alias("text"))
    one = parts.where("whole = 1").select(F.concat(F.lit("{"), F.regexp_replace("text", r"^[\s{},]*", ""), F.lit("}}")).alias("value"))
    return manifest(one)


def inventory(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """path and length of files by suffix, whatever its case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes))


def publishable(files: DataFrame) -> DataFrame:
    keep = F.lit(True)
    for pattern in IGNORED:
        keep = keep & ~F.rlike("path", F.lit(pattern))
    return files.where(keep)


def write_flat(df: DataFrame, path: str, parquet: bool = True) -> None:
    """A flat table as CSV with a header under path/csv, and as Parquet under path/parquet unless that is not wanted."""
    df.write.option("header", True).csv(f"{path}/csv")
    if parquet:
        df.write.parquet(f"{path}/parquet")


def _files(spark: SparkSession, path: str):
    """(the file system of path, its class of paths)"""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions under path, lowest first."""
    fs, of = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(of(path))] if fs.exists(of(path)) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def publish(df: DataFrame, path: str, keep: int = 2) -> int:
    """Publishes df as the next version under path, and gives its number.

    It is written beside and gets its name by one rename to a name that is not yet there: until then readers find the
    version before, and from then on this one, never a part of a table and never none. A job lost before leaves a folder
    without a version's name, which no reader looks at. The last `keep` versions stay, so that readers of the one before
    can finish. One job publishes at a time; df may be read from an earlier version.
    """
    fs, of = _files(df.sparkSession, path)
    new = of(f"{path}/_new-{uuid.uuid4().hex}")
    df.write.parquet(new.toString())
    held = versions(df.sparkSession, path)
    number = held[-1] + 1 if held else 1
    if not fs.rename(new, of(f"{path}/v{number:010d}")):
        raise OSError(f"version {number} of {path} could not be named")
    for old in held[: max(0, len(held) + 1 - keep)]:
        fs.delete(of(f"{path}/v{old:010d}"), True)
    return number


def published(spark: SparkSession, path: str) -> DataFrame:
    """The newest version under path."""
    held = versions(spark, path)
    if not held:
        raise FileNotFoundError(f"nothing is published under {path}")
    return spark.read.parquet(f"{path}/v{held[-1]:010d}")
