"""Tables of counts, box-plot statistics and density curves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipyard.functions import labels
from clipyard.functions.scalars import mapped
from clipyard.operators.metadata import donor_paths
from clipyard.operators.scans import Scan, ordered
from clipyard.sources.tables import scratch


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of column values by row, in the order given, others dropped; total over what is shown."""
    out = df.where(F.col(column).isin(values)).groupBy(row).pivot(column, values).count().na.fill(0)
    return out.withColumn("total", sum((F.col(v) for v in values), F.lit(0)))


def box_stats(df: DataFrame, by: list[str], x: str, whisker: float = 1.5, most: int | None = None) -> DataFrame:
    """Quartiles (between neighbours in proportion), ends of whiskers (the last values within `whisker` interquartile ranges) and number of outliers.

    Exact: equal values are counted first, a scan in order gives each value the places it takes, and a quartile is read
    off at its place. No group's values are gathered.
    """
    values = scratch(df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("v_")).agg(F.count("*").alias("n_")), "values")
    placed = ordered(values, by, ["v_"], most).scan(before_=Scan("sum", F.col("n_"), own=False)).result()
    size = values.groupBy(*by).agg(F.sum("n_").alias("all_"))
    held = placed.join(size, by)
    picks = []
    for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        place = F.lit(share) * (F.col("all_") - 1)
        at = lambda p: F.max(F.when((F.col("before_") <= p) & (p < F.col("before_") + F.col("n_")), F.col("v_")))
        picks += [at(F.floor(place)).alias(f"{name}_lo"), at(F.ceil(place)).alias(f"{name}_hi"), F.max(place - F.floor(place)).alias(f"{name}_w")]
    s = held.groupBy(*by).agg(*picks)
    s = s.select(*by, *((F.col(f"{q}_lo") * (1 - F.col(f"{q}_w")) + F.col(f"{q}_hi") * F.col(f"{q}_w")).alias(q) for q in ("q1", "median", "q3")))
    reach = (F.col("q3") - F.col("q1")) * whisker
    within = F.col("v_").between(F.col("q1") - reach, F.col("q3") + reach)
    return values.join(s, by).groupBy(*by, "q1", "median", "q3").agg(F.min(F.when(within, F.col("v_"))).alias("whisker_lo"), F.max(F.when(within, F.col("v_"))).alias("whisker_hi"), F.coalesce(F.sum(F.when(~within, F.col("n_"))), F.lit(0)).alias("outliers"))


#: Bandwidths beyond which a value adds less than 1e-13 of its weight to a density.
NEAR = 8


def density(df: DataFrame, by: str, x: str, step: float, points: int = 200) -> DataFrame:
    """Gaussian density of x for each value of `by` on a grid of its own, Scott's bandwidth.

    x is counted on steps first, so the grid meets bins and not rows; and a grid point meets only the bins in its own
    and the neighbouring cells of NEAR bandwidths, so that the pairs are as few as the bandwidth is narrow.
    """
    s = df.groupBy(by).agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("a"), F.max(x).alias("b")).withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).where("h > 0")
    cell = lambda at: F.floor((at - F.col("a")) / (NEAR * F.col("h")))
    counted = df.where(F.col(x).isNotNull()).groupBy(by, (F.round(F.col(x) / step) * step).alias("v")).agg(F.count("*").alias("m"))
    bins = counted.join(s.select(by, "a", "h"), by).select(by, "v", "m", cell(F.col("v")).alias("cell"))
    grid = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", F.col("a") - 3 * F.col("h") + F.col("i") * (F.col("b") - F.col("a") + 6 * F.col("h")) / (points - 1))
    near = grid.withColumn("cell", F.explode(F.array(cell(F.col("at")) - 1, cell(F.col("at")), cell(F.col("at")) + 1)))
    z = (F.col("at") - F.col("v")) / F.col("h")
    total = F.coalesce(F.sum(F.col("m") * F.exp(-z * z / 2)), F.lit(0.0))
    return near.join(bins, [by, "cell"], "left").groupBy(by, "i", "at").agg((total / F.first("n") / F.first("h") / math.sqrt(2 * math.pi)).alias("density"))


def wide(df: DataFrame, row: str, cell: Column, values: list[str]) -> DataFrame:
    """Counts by row, a column for each of the values of `cell`."""
    return df.withColumn("cell_", cell).groupBy(row).pivot("cell_", values).count().na.fill(0)


def transfer(entries: DataFrame, first_match: bool = False) -> DataFrame:
    """Counts of dialect by donor_dialect of manifest entries (dialect, video_id, donor_dialect, donor_video_id, donor_audio_paths, donor_clips): the donor's by its field, or else by its video id, or else one count for the folder of each donor clip."""
    named = lambda x: labels.dialect_in(x, first_match)
    folder = lambda path: F.coalesce(F.element_at(F.split(path, "/"), F.when(F.size(F.split(path, "/")) > 1, -2)), F.lit(""))
    own, field, video = F.coalesce("dialect", F.lit("")), F.col("donor_dialect"), F.col("donor_video_id")
    found = F.when(~labels.blank(field), F.array(mapped(field, labels.DIALECTS, named(field)))).when(~labels.blank(video), F.array(named(video))).otherwise(F.transform(donor_paths(F.struct("donor_audio_paths", "donor_clips")), lambda p: named(folder(p))))
    return entries.select(mapped(own, labels.DIALECTS, named(F.col("video_id"))).alias("dialect"), F.explode(found).alias("donor_dialect")).groupBy("dialect", "donor_dialect").agg(F.count("*").alias("n"))


def first_errors(df: DataFrame, failed: Column, order: str, n: int = 10) -> DataFrame:
    """The first n failed rows in the order, and how many there are in all."""
    bad = df.where(failed)
    total = bad.agg(F.count("*").alias("n_errors"))  # one row
    return bad.orderBy(order).limit(n).join(F.broadcast(total))


def in_order(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """`by`, n and place, from 1: those of the order first, in it; where none is there, by falling count. One row per category."""
    c = df.groupBy(by).agg(F.count("*").alias("n"))
    wanted = F.col(by).isin(order)
    some = c.agg(F.coalesce(F.bool_or(wanted), F.lit(False)).alias("some"))
    c = c.join(F.broadcast(some)).where(wanted | ~F.col("some"))
    key = F.when(F.col("some"), preferred(F.col(by), order)).otherwise(-F.col("n"))
    return c.select(by, "n", F.row_number().over(Window.orderBy(key, by)).alias("place"))


def preferred(x: Column, order: list[str]) -> Column:
    """Sort key: place in the order, others after."""
    at = F.array_position(F.array(*(F.lit(v) for v in order)), x)
    return F.when(at > 0, at).otherwise(len(order) + 1)
