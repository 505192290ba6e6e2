"""Group-disjoint splits, balanced method assignment, leak-free donors. Random order is md5(seed|key): the same under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipyard.operators.scans import numbered
from clipyard.sources.tables import scratch


def ticket(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys).cast("binary"))


def _cut(rn: Column, n: Column, ratios: tuple[float, float]) -> Column:
    train, val = (F.floor(F.lit(r) * n) for r in ratios)
    return F.when(rn <= train, "train").when(rn <= train + val, "val").otherwise("test")


def assign_splits(clips: DataFrame, ood: list[str], seed: int, ratios=(0.7, 0.15), few_shot=(0.1, 0.1), most: int | None = None, unit: str = "video_id") -> DataFrame:
    """clips with p1 and p2: a split per video, shuffled in each (dialect, environment) and cut by ratios, rounded down. Protocol 1 keeps dialects of `ood` for tests of their own, protocol 2 cuts them by few_shot. Only videos are shuffled; the clips join them. unit: the column that is kept together, such as the source link of several videos, in place of the video."""
    videos = clips.groupBy(F.col(unit).alias("unit_")).agg(F.min(F.struct("dialect", "environment")).alias("x")).select("unit_", "x.*")
    groups = videos.groupBy("dialect", "environment").agg(F.count("*").alias("n"))
    drawn = numbered(videos.withColumn("ticket", ticket(seed, "unit_")), ["dialect", "environment"], ["ticket", "unit_"], "rn", most).drop("ticket")
    v = _with_groups(drawn, groups, ["dialect", "environment"]).withColumn("rn", F.col("rn") + 1)
    out = F.col("dialect").isin(ood)
    usual = _cut(F.col("rn"), F.col("n"), ratios)
    named = lambda x: F.when(x == "test", "test_id").otherwise(x)
    v = v.select("unit_", F.when(out, F.concat(F.lit("test_ood_"), "dialect")).otherwise(named(usual)).alias("p1"), F.when(out, _cut(F.col("rn"), F.col("n"), few_shot)).otherwise(named(usual)).alias("p2"))
    return clips.join(v, F.col(unit) == F.col("unit_")).drop("unit_")


def _with_groups(df: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """df with the columns of its group, nulls being groups too; which side is broadcast is left to Spark."""
    other = groups.select(*(F.col(c).alias(f"{c}_g") for c in key), *(c for c in groups.columns if c not in key))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_g")) for c in key]
    return df.join(other, same).drop(*(f"{c}_g" for c in key))


def turns(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `name`: its place from 0 in the order, without a single-task window: ranges are counted, and each gets the sum before it."""
    ranged = scratch(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("part_").agg(F.count("*").alias("n_"))  # one row per range
    before = counts.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    rn = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return ranged.join(F.broadcast(before), "part_").withColumn(name, rn - 1 + F.col("before_")).drop("part_", "before_")


def assign_methods(clips: DataFrame, methods: list[str]) -> DataFrame:
    """clips (p1, p2, key) with assigned_method, in turn over all clips by group in order of first appearance, then key; so counts differ by one at most."""
    groups = clips.groupBy("p1", "p2").agg(F.min("key").alias("first_key"))
    placed = turns(clips.join(F.broadcast(groups), ["p1", "p2"]), ["first_key", "key"], "turn")
    return placed.withColumn("assigned_method", F.element_at(F.array(*(F.lit(m) for m in methods)), (F.col("turn") % len(methods)).cast("int") + 1)).drop("first_key", "turn")


def places(n: Column, k: int, *seeds: Column | str) -> Column:
    """k different places in 0 to n - 1 (all, where n is less), each choice as likely: the t-th is drawn among the n - t left, and goes past those drawn before it."""
    draw = lambda t: F.conv(F.substring(F.md5(F.concat_ws("|", *seeds, t.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % (n - t)
    past = lambda acc, x: F.aggregate(F.array_sort(acc), x, lambda at, c: at + F.when(at >= c, 1).otherwise(0))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.least(n, F.lit(k)).cast("int") - 1), F.array().cast("array<bigint>"), lambda acc, t: F.concat(acc, F.array(past(acc, draw(t))))))


def assign_donors(clips: DataFrame, seed: int, k: int = 3, most: int | None = None) -> DataFrame:
    """clips (p1, p2, video_id, key, audio_path) with donor_video_id (another video of the same group, each as likely; null where there is none) and up to k of its audio paths.

    Both choices are places in an order, drawn from the seed and the clip's key: the video's among those of its group,
    the clips' among those of the video. So both are equi-joins on a place, and no list of a video's clips is gathered.
    """
    group, video = ["p1", "p2"], ["p1", "p2", "video_id"]
    videos = clips.groupBy(*video).agg(F.count("*").alias("n_clips"))
    v = scratch(_with_groups(numbered(videos, group, ["video_id"], "idx", most), videos.groupBy(*group).agg(F.count("*").alias("n")), group), "videos")
    draw = F.conv(F.substring(ticket(seed, "key"), 1, 8), 16, 10).cast("long") % (F.col("n") - 1)
    own = _with_groups(clips, v.select(*video, F.col("idx").alias("own"), "n"), video).withColumn("draw", F.when(F.col("n") > 1, draw))
    own = own.withColumn("idx", F.col("draw") + (F.col("draw") >= F.col("own")).cast("int")).drop("own", "n", "draw")
    donors = v.select(*(F.col(c).alias(f"{c}_d") for c in group), F.col("idx").alias("idx_d"), F.col("video_id").alias("donor_video_id"), "n_clips")
    chosen = own.join(donors, [F.col(c).eqNullSafe(F.col(f"{c}_d")) for c in group] + [F.col("idx") == F.col("idx_d")], "left").drop("p1_d", "p2_d", "idx", "idx_d")
    wanted = chosen.where("n_clips > 0").select("key", *group, "donor_video_id", F.posexplode(places(F.col("n_clips"), k, F.lit(str(seed)), F.col("key"))).alias("t", "place"))
    placed = numbered(clips.select(*video, "key", "audio_path"), video, ["audio_path", "key"], "place_d", most).select(*(F.col(c).alias(f"{c}_d") for c in group), F.col("video_id").alias("donor_d"), "place_d", "audio_path")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_d")) for c in group] + [F.col("donor_video_id") == F.col("donor_d"), F.col("place") == F.col("place_d")]
    paths = wanted.join(placed, same).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("t", "audio_path"))).alias("held"))  # k at most
    out = chosen.drop("n_clips").join(paths.withColumnRenamed("key", "key_p"), F.col("key") == F.col("key_p"), "left")
    return out.withColumn("donor_audio_paths", F.coalesce(F.transform("held", lambda x: x["audio_path"]), F.array().cast("array<string>"))).drop("held", "key_p")
