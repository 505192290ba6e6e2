"""Metrics of real and faked sound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipyard.functions import audio
from clipyard.functions import scalars as S

FEATURES = ("rms_db", "crest_factor_db", "spectral_centroid", "spectral_rolloff", "zero_crossing_rate")


def features(df: DataFrame, wave: str) -> DataFrame:
    """df with loudness, crest and spectral measures of a column of samples; rows without samples go."""
    w = F.transform(wave, lambda x: x.cast("double"))
    return df.where(F.size(wave) > 0).withColumn("s_", audio.spectral(F.col(wave))).withColumns({"rms_db": S.loudness_db(w), "crest_factor_db": S.crest_db(w)}).select("*", "s_.*").drop("s_")


def metrics(real: DataFrame, fake: DataFrame) -> DataFrame:
    """One table of both: real (clip_id, wave), fake (clip_id, method, wave, embedding, donor). Similarity is 1 for the real ones, null where no donor is usable."""
    r = real.select("clip_id", F.lit("Real").alias("type"), F.lit("Real").alias("method"), F.lit(1.0).alias("speaker_similarity"), "wave")
    f = fake.select("clip_id", F.lit("Fake").alias("type"), "method", S.cosine(F.col("embedding"), F.col("donor")).alias("speaker_similarity"), "wave")
    return features(r.unionByName(f), "wave").drop("wave")


def first_donors(tasks: DataFrame) -> DataFrame:
    """donor_video_id and donor, its embedding: that of the first task (by task_order) with usable donor files."""
    return tasks.where(F.col("donor").isNotNull()).groupBy("donor_video_id").agg(F.min_by("donor", "task_order").alias("donor"))


def mean_vectors(clips: DataFrame, by: str, vector: str) -> DataFrame:
    """`by`, mean over its valid vectors (null where there is none) and error, which names that."""
    each = clips.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda z: z["m"]).alias("mean"))
    return clips.select(by).distinct().join(means, by, "left").withColumn("error", F.when(F.col("mean").isNull(), "no valid donor clip"))
