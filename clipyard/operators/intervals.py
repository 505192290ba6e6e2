"""Interval operators: overlap, containment, cuts, nearest sample.

Overlaps are found by an index of levels: an interval stands at the first level whose bins are as wide as it is long,
each level's twice as wide as those below, so it meets two bins at most however long it is. Two intervals meet at the
higher of their levels; the other one climbs there. Equi-joins on (key, level, bin) stand in for range joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipyard.operators.scans import Scan, ordered


def level_of(length: Column, unit: float) -> Column:
    """The first level with bins as wide as length, but for what a sum of floats is off."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(unit)) / unit) - 1e-9)).cast("int")


def _bins(start: Column, end: Column, level: Column, unit: float) -> Column:
    at = lambda x: F.floor(x / (unit * F.pow(F.lit(2.0), level)))
    return F.sequence(at(start), F.greatest(at(start), at(end)))


def _placed(df: DataFrame, levels: DataFrame | list[int], home: str, climbed: str, unit: float) -> DataFrame:
    """Rows of df (a_, b_, l_) by part, level and bin: at home in the parts `home`, at each higher one of the other side's levels in the parts `climbed`."""
    if isinstance(levels, list):
        with_levels = df.withColumn("levels_", F.array(*(F.lit(x) for x in levels)).cast("array<int>"))
    else:
        with_levels = df.join(F.broadcast(levels))  # one row

    def at(parts: tuple[int, ...], level: Column) -> Column:
        of = lambda part: F.transform(_bins(F.col("a_"), F.col("b_"), level, unit), lambda b: F.struct(F.lit(part).alias("part_"), level.alias("level_"), b.alias("bin_")))
        return F.flatten(F.array(*map(of, parts)))

    places = F.concat(at(home, F.col("l_")), F.flatten(F.transform(F.filter("levels_", lambda x: x > F.col("l_")), lambda x: at(climbed, x))))
    return with_levels.withColumn("p_", F.explode(places)).select(*df.columns, "p_.*").drop("levels_")


def overlapping(one: DataFrame, two: DataFrame, key: list[str], unit: float, longest: float | None = None) -> DataFrame:
    """Pairs of one (key, start, end) and two (key, s, e) with s < end and e > start, each once, with all columns of both. A point is an interval that ends where it starts.

    An interval takes two bins at most at its own level and two at each higher level that the other side has, so its
    rows grow with the logarithm of the longest length. unit: bins of the lowest level. longest: bound of the lengths
    in one, where known, which spares a look at them.
    """
    left = one.withColumns({"a_": F.col("start"), "b_": F.col("end"), "l_": level_of(F.col("end") - F.col("start"), unit)})
    right = two.withColumns({"a_": F.col("s"), "b_": F.col("e"), "l_": level_of(F.col("e") - F.col("s"), unit)})
    of = lambda df: df.agg(F.collect_set("l_").alias("levels_"))  # noqa: E731  a few dozen numbers at most
    bound = None if longest is None else list(range(max(0, int(-(-longest // unit)) - 1).bit_length() + 1))
    # Pairs at the left one's level, with the right one at home or climbed, are part 0; those at the right one's higher level part 1.
    left = _placed(left, of(right), (0,), (1,), unit).select(*one.columns, F.col("l_").alias("ll_"), "part_", "level_", "bin_")
    right = _placed(right, of(left.select(F.col("ll_").alias("l_"))) if bound is None else bound, (0, 1), (0,), unit).select(*two.columns, F.col("l_").alias("lr_"), "part_", "level_", "bin_")
    met = left.join(right, [*key, "part_", "level_", "bin_"])
    first = F.floor(F.greatest("start", "s") / (unit * F.pow(F.lit(2.0), F.col("level_")))) == F.col("bin_")  # of two bins that both are in
    return met.where(first & (F.col("s") < F.col("end")) & (F.col("e") > F.col("start"))).drop("part_", "level_", "bin_", "ll_", "lr_")


def coverage(windows: DataFrame, intervals: DataFrame, key: list[str], unit: float, longest: float | None = None) -> DataFrame:
    """windows (key, start, end) with `covered`: seconds of intervals (key, s, e) in each over its length; overlapping intervals count each."""
    met = overlapping(windows.select(*key, "start", "end").distinct(), intervals.select(*key, "s", "e"), key, unit, longest)
    seconds = met.groupBy(*key, "start", "end").agg(F.sum(F.least("end", "e") - F.greatest("start", "s")).alias("secs"))
    return windows.join(seconds, [*key, "start", "end"], "left").withColumn("covered", F.coalesce(F.col("secs"), F.lit(0.0)) / (F.col("end") - F.col("start"))).drop("secs")


#: Times are counted in ticks of 1e-10 seconds, so that sums over any number of rows are exact.
TICKS = 10**10


def _ticks(x: Column) -> Column:
    return (x.cast("decimal(25,10)") * F.lit(TICKS).cast("decimal(11,0)")).cast("decimal(25,0)")


def _between(windows: DataFrame, points: DataFrame, key: list[str], value: Column, sums: dict[str, Column], most: int | None) -> DataFrame:
    """key, start, end and `value`: at the end less at the start of each window (key, start, end, without nulls, start before end), as comes from the running sums over the points (key, t_, kind_ = 1, columns) and the time t_. The end stands before the points at its time, the start behind them."""
    w = windows.select(*key, "start", "end").where("start < end").distinct()
    ends = w.select("*", F.explode(F.array(F.struct(F.col("end").alias("t_"), F.lit(0).alias("kind_")), F.struct(F.col("start").alias("t_"), F.lit(2).alias("kind_")))).alias("x_")).select(*key, "start", "end", "x_.*")
    both = ends.unionByName(points, allowMissingColumns=True)
    for c in key:  # a key that is null meets none
        both = both.where(F.col(c).isNotNull())
    seen = ordered(both, key, ["t_", "kind_"], most).scan(**{name: Scan("sum", x) for name, x in sums.items()}).result()
    signed = F.when(F.col("kind_") == 0, value).otherwise(-value)
    return seen.where("kind_ <> 1").groupBy(*key, "start", "end").agg(F.sum(signed).alias("value"))


def dense_coverage(windows: DataFrame, intervals: DataFrame, key: list[str], most: int | None = None) -> DataFrame:
    """As coverage, where windows meet so many intervals that pairs of them are out of the question: time and memory grow with the rows, not with the overlaps.

    The seconds of all intervals up to a time t are t * (begun - ended) - (sum of begins - sum of ends) over those before it, so a window's are what
    they come to at its end less at its start. These large numbers nearly cancel out, hence ticks instead of doubles.
    """
    i = intervals.select(*key, "s", "e").where("s < e")
    points = i.select(*key, F.explode(F.array(F.struct(F.col("s").alias("t_"), F.lit(1).alias("one_")), F.struct(F.col("e").alias("t_"), F.lit(-1).alias("one_")))).alias("x_")).select(*key, "x_.*", F.lit(1).alias("kind_"))
    open_, begun = F.coalesce("one_", F.lit(0)), F.coalesce(F.col("one_").cast("decimal(1,0)") * _ticks(F.col("t_")), F.lit(0)).cast("decimal(25,0)")
    upto = (F.col("n_").cast("decimal(12,0)") * _ticks(F.col("t_")) - F.col("sum_")).cast("decimal(38,0)")
    seconds = _between(windows, points, key, upto, {"n_": open_, "sum_": begun}, most).withColumnRenamed("value", "secs_")
    length = (_ticks(F.col("end")) - _ticks(F.col("start"))).cast("double")
    return windows.join(seconds, [*key, "start", "end"], "left").withColumn("covered", F.coalesce(F.col("secs_").cast("double"), F.lit(0.0)) / length).drop("secs_")


def cuts_inside(windows: DataFrame, cuts: DataFrame, key: list[str], most: int | None = None) -> DataFrame:
    """key, start, end, n_cuts of windows with cuts (key, cut) strictly inside: cuts before the end less those up to the start."""
    points = cuts.select(*key, F.col("cut").alias("t_"), F.lit(1).alias("kind_"), F.lit(1).alias("one_")).where("t_ IS NOT NULL")
    return _between(windows, points, key, F.col("n_"), {"n_": F.coalesce("one_", F.lit(0))}, most).withColumnRenamed("value", "n_cuts").where("n_cuts > 0")


def without_cuts(windows: DataFrame, cuts: DataFrame, key: list[str], most: int | None = None) -> DataFrame:
    """windows with no cut (key, cut) strictly inside."""
    return windows.join(cuts_inside(windows, cuts, key, most), [*key, "start", "end"], "left_anti")


def merged(intervals: DataFrame, key: list[str], tolerance: float = 0.0, most: int | None = None) -> DataFrame:
    """Disjoint intervals (key, s, e) that cover the given ones, each widened by tolerance."""
    wide = intervals.select(*key, (F.col("s") - tolerance).alias("s"), (F.col("e") + tolerance).alias("e"))
    seen = ordered(wide, key, ["s", "e"], most).scan(reach=Scan("max", F.col("e"), own=False))
    apart = F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)
    island = seen.with_columns(new_=apart).scan(island=Scan("sum", F.col("new_"))).result()
    return island.groupBy(*key, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def inside(points: DataFrame, intervals: DataFrame, key: list[str], time: str, tolerance: float, most: int | None = None) -> DataFrame:
    """points with `inside`: time in any interval widened by tolerance, ends included. The last merged interval that starts at or before the point decides, so one ordered scan does."""
    m = merged(intervals, key, tolerance, most).select(*key, F.col("s").alias("t_"), F.col("e").alias("until"), F.lit(0).alias("kind"))
    p = points.withColumns({"t_": F.col(time), "kind": F.lit(1), "until": F.lit(None).cast("double")})
    both = ordered(p.unionByName(m, allowMissingColumns=True), key, ["t_", "kind"], most).scan(open=Scan("last", F.col("until"))).result()
    return both.where("kind = 1").withColumn("inside", F.coalesce(F.col("t_") <= F.col("open"), F.lit(False))).drop("t_", "kind", "until", "open")


def nearest(frames: DataFrame, samples: DataFrame, key: list[str], reach: int, value: str, most: int | None = None) -> DataFrame:
    """frames (key, frame) with the frame and value of the nearest sample within `reach` frames; the earlier of two as near."""
    s = samples.select(*key, "frame", F.struct("frame", value).alias("held"), F.lit(0).alias("kind"))
    f = frames.withColumn("kind", F.lit(1))
    both = ordered(f.unionByName(s, allowMissingColumns=True), key, ["frame", "kind"], most).scan(prev_=Scan("last", F.col("held")), next_=Scan("last", F.col("held"), back=True)).result()
    back, ahead = F.col("frame") - F.col("prev_.frame"), F.col("next_.frame") - F.col("frame")
    pick = F.when(F.col("next_").isNull() | (back <= ahead), F.col("prev_")).otherwise(F.col("next_"))
    out = both.where("kind = 1").withColumn("pick_", pick)
    near = F.abs(F.col("pick_.frame") - F.col("frame")) <= reach
    return out.select(*frames.columns, F.when(near, F.col("pick_.frame")).alias("near_frame"), F.when(near, F.col(f"pick_.{value}")).alias(value))
