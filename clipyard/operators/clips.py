"""From labelled detections to ranked speaking clips. `key` columns name a track: (video_id, track_id)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipyard.functions.scalars import rounded
from clipyard.operators.intervals import coverage, cuts_inside, inside
from clipyard.operators.scans import Scan, numbered, ordered
from clipyard.sources.tables import scratch

TRACK = ["video_id", "track_id"]


@dataclass(frozen=True)
class Rules:
    """Lengths in seconds. min_len and period must be positive, max_len at least min_len."""

    max_gap: float = 1.0
    min_len: float = 5.0
    max_len: float = 10.0
    period: float = 0.2  # one over the sample rate
    frame_height: float = 720.0
    min_presence: float = 0.8
    min_face: float = 0.1
    min_speech: float = 0.5
    per_video: int = 15

    def __post_init__(self) -> None:
        if self.min_len <= 0 or self.max_len < self.min_len or self.period <= 0:
            raise ValueError("lengths must be positive and max_len at least min_len")


def mouth_motion(d: DataFrame, most: int | None = None) -> DataFrame:
    """d (track, time_sec, opening) with motion: change of opening against the last one that is not null; 0 for the first and for nulls."""
    seen = ordered(d, TRACK, ["time_sec", "frame"], most).scan(last_=Scan("last", F.col("opening"), own=False)).result()
    return seen.withColumn("motion", F.coalesce(F.abs(F.col("opening") - F.col("last_")), F.lit(0.0))).drop("last_")


def talking(d: DataFrame, speech: DataFrame, tolerance: float, least_motion: float, least_opening: float, most: int | None = None) -> DataFrame:
    """d with is_talking: in speech, and the mouth moves or is open enough; never where the opening is null."""
    moving = (F.col("motion") >= least_motion) | (F.col("opening") >= least_opening)
    return inside(mouth_motion(d, most), speech, ["video_id"], "time_sec", tolerance, most).withColumn("is_talking", F.col("inside") & F.coalesce(moving & F.col("opening").isNotNull(), F.lit(False)))


def long_enough(videos: DataFrame, min_len: float) -> DataFrame:
    """Videos (duration) that can hold a clip; those of unknown duration go."""
    return videos.where(F.col("duration") >= min_len)


def runs(d: DataFrame, rules: Rules, most: int | None = None) -> DataFrame:
    """Islands of talking samples no more than max_gap apart: track, run_id (from 0), start, end (a period after the last), n."""
    seen = ordered(d.where("is_talking"), TRACK, ["time_sec", "frame"], most).scan(before_=Scan("last", F.col("time_sec"), own=False))
    apart = F.when(F.col("time_sec") - F.col("before_") > rules.max_gap, 1).otherwise(0)
    run = seen.with_columns(apart_=apart).scan(run_id=Scan("sum", F.col("apart_"))).result()
    return run.groupBy(*TRACK, "run_id").agg(F.min("time_sec").alias("start"), (F.max("time_sec") + rules.period).alias("end"), F.count("*").alias("n"))


def tiles(r: DataFrame, rules: Rules) -> DataFrame:
    """Windows of max_len along each run; a tail of at least min_len counts, a shorter one is dropped."""
    length = F.col("end") - F.col("start")
    cut = r.where(length >= rules.min_len).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((length - rules.min_len) / rules.max_len).cast("int"))))
    at = F.col("start") + F.col("k") * rules.max_len
    return cut.select(*TRACK, "run_id", "k", at.alias("start"), F.least(at + rules.max_len, F.col("end")).alias("end"))


def window_stats(w: DataFrame, d: DataFrame, rules: Rules) -> DataFrame:
    """w with statistics of all detections of its track in [start, end). A window meets at most two bins of max_len."""
    bins = F.sequence(F.floor(F.col("start") / rules.max_len), F.floor(F.col("end") / rules.max_len))
    one = w.withColumn("bin", F.explode(bins))
    two = d.select(*TRACK, F.floor(F.col("time_sec") / rules.max_len).alias("bin"), "time_sec", "is_talking", "confidence", "x1", "y1", "x2", "y2")
    met = one.join(two, [*TRACK, "bin"]).where("start <= time_sec AND time_sec < end")
    s = met.groupBy(*TRACK, "start", "end").agg(
        F.count("*").alias("n"), F.avg(F.col("is_talking").cast("double")).alias("talking"), F.median(F.col("y2") - F.col("y1")).alias("face"), F.avg("confidence").alias("mean_confidence"), F.array(*(F.median(c) for c in ("x1", "y1", "x2", "y2"))).alias("median_bbox")
    )
    expected = F.greatest(F.lit(1.0), F.bround((F.col("end") - F.col("start")) / rules.period))
    return w.join(s, [*TRACK, "start", "end"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "presence": F.coalesce("n", F.lit(0)) / expected, "talking": F.coalesce("talking", F.lit(0.0)), "face": F.coalesce(F.col("face") / rules.frame_height, F.lit(0.0))})


def gate(w: DataFrame, rules: Rules) -> Column:
    """The first reason to reject, in order; null where accepted. Ratios count to 8 digits, so that one that is as large as its least is not rejected for what a sum of doubles is off."""
    below = lambda c, least: F.round(c, 8) < least
    return F.when(below("presence", rules.min_presence), "presence").when(F.col("n_cuts") > 0, "cut").when(below("face", rules.min_face), "face").when(below("speech", rules.min_speech), "speech")


def quality(d: DataFrame, speech: DataFrame, cuts: DataFrame, rules: Rules) -> DataFrame:
    """Every window with its statistics and reject_reason."""
    w = window_stats(tiles(runs(d, rules), rules), d, rules)
    w = coverage(w, speech, ["video_id"], rules.max_len, rules.max_len).withColumnRenamed("covered", "speech")
    n = cuts_inside(w, cuts, ["video_id"])
    w = w.join(n, ["video_id", "start", "end"], "left").withColumn("n_cuts", F.coalesce("n_cuts", F.lit(0)))
    return w.withColumn("reject_reason", gate(w, rules))


#: Windows of a stretch that are gathered in one array, and those of a longer one, its best, that one task goes through in the first round.
IN_ARRAY, BLOCK = 1000, 200_000


def suppressed(w: DataFrame, order: list[Column], in_array: int = IN_ARRAY, most: int | None = None, block: int = BLOCK) -> DataFrame:
    """Of each track's windows (start before end), best first, those that overlap no better kept one (ends may touch).

    order: ascending columns, without ties in a track. A stretch is as many windows as overlap one after another. Those
    of up to in_array windows are gone through in one array each. Of a longer one the best `block` windows are gone
    through in order, in a task that holds the kept ones only; of the others those that overlap a kept one go, and what
    is left falls into shorter stretches, which are the windows of the next round. The block doubles with each round, so
    the rounds are no more than the logarithm of the longest stretch.
    """
    names = [f"o{i}_" for i in range(len(order))]
    left, kept = w.withColumns(dict(zip(names, order, strict=True))), None
    while True:
        seen = ordered(left, TRACK, ["start", "end"], most).scan(reach_=Scan("max", F.col("end"), own=False))
        apart = F.when(F.col("start") >= F.col("reach_"), 1).otherwise(0)
        cut = scratch(seen.with_columns(apart_=apart).scan(stretch_=Scan("sum", F.col("apart_"))).result().drop("reach_", "apart_"), "stretches")
        size = cut.groupBy(*TRACK, "stretch_").agg(F.count("*").alias("n_"))
        large = size.where(F.col("n_") > in_array).drop("n_")
        key = [*TRACK, "stretch_"]
        if large.isEmpty():
            small = _by_array(cut, names).select(*w.columns)
            return small if kept is None else kept.unionByName(small)
        small = _by_array(cut.join(large, key, "left_anti"), names).select(*w.columns)
        best, left = _by_block(cut.join(large, key, "left_semi"), key, names, most, block)
        kept = small.unionByName(best.select(*w.columns)) if kept is None else kept.unionByName(small).unionByName(best.select(*w.columns))
        left, block = left.drop("stretch_"), 2 * block


def _by_array(cut: DataFrame, order: list[str]) -> DataFrame:
    """Kept windows of stretches (stretch_), each gathered in an array."""
    item = F.struct(F.struct(*order).alias("rank_"), *(c for c in cut.columns if c not in (*TRACK, "stretch_")))
    best_first = F.array_sort(F.collect_list(item))
    kept = F.aggregate(
        best_first,
        F.filter(best_first, lambda x: F.lit(False)),
        lambda acc, c: F.when(F.exists(acc, lambda k: (k["start"] < c["end"]) & (c["start"] < k["end"])), acc).otherwise(F.concat(acc, F.array(c))),
    )
    return cut.groupBy(*TRACK, "stretch_").agg(kept.alias("k")).select(*TRACK, "stretch_", F.inline("k")).drop("rank_")


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """g_ and p of kept windows, of rows (g_, p, start, end) by g_ and p. Kept ones are disjoint, so the last that starts before a window's end tells whether it overlaps any."""
    group, starts, ends = None, [], []
    for pdf in batches:
        keep = []
        for g, start, end in zip(pdf["g_"], pdf["start"], pdf["end"], strict=True):
            if g != group:
                group, starts, ends = g, [], []
            i = bisect_left(starts, end)
            keep.append(i == 0 or ends[i - 1] <= start)
            if keep[-1]:
                starts.insert(i, start)
                ends.insert(i, end)
        yield pdf.loc[keep, ["g_", "p"]]


def _by_block(cut: DataFrame, key: list[str], order: list[str], most: int | None, block: int) -> tuple[DataFrame, DataFrame]:
    """Kept windows among the best `block` ones of each stretch, and those of the others that overlap none of them."""
    named = cut.withColumn("g_", F.to_json(F.struct(*key)))  # one text for a stretch, also where part of its key is null
    placed = scratch(numbered(named, ["g_"], order, "p", most), "ranked")
    head, rest = placed.where(F.col("p") < block), placed.where(F.col("p") >= block)
    in_order = head.select("g_", "p", "start", "end").repartition("g_").sortWithinPartitions("g_", "p")
    kept = scratch(head.join(in_order.mapInPandas(_greedy, "g_ string, p bigint"), ["g_", "p"], "left_semi"), "kept")
    starts = kept.select("g_", F.col("start").alias("t_"), F.lit(1).alias("kind_"), F.col("end").alias("until_"))
    both = rest.withColumns({"t_": F.col("end"), "kind_": F.lit(0)}).unionByName(starts, allowMissingColumns=True)
    seen = ordered(both, ["g_"], ["t_", "kind_"], most).scan(reach_=Scan("max", F.col("until_"), own=False)).result()
    left = seen.where("kind_ = 0 AND (reach_ IS NULL OR reach_ <= start)")
    return kept, left.drop("g_", "p", "t_", "kind_", "until_", "reach_")


ROUNDED = {"talking": 4, "speech": 4, "face": 4, "presence": 4}


def top(w: DataFrame, rules: Rules) -> DataFrame:
    """The best per_video accepted windows of each video by rounded (talking, speech, face, presence), then track and start; ordinal from 0 and file name. Runs that are a period apart or more can't overlap, so suppression is skipped then."""
    ok = w.where("reject_reason IS NULL")
    by = [rounded(F.col(c), n) for c, n in ROUNDED.items()]
    if rules.max_gap < rules.period:
        ok = suppressed(ok, [*(-c for c in by), F.col("start")])
    rn = F.row_number().over(Window.partitionBy("video_id").orderBy(*(c.desc() for c in by), "track_id", "start"))
    ok = ok.withColumn("ordinal", rn - 1).where(F.col("ordinal") < rules.per_video)
    return ok.withColumn("clip_filename", F.format_string("%03d_%010.3f.mp4", "ordinal", rounded(F.col("start"), 3)))


def diagnostics(d: DataFrame, r: DataFrame, w: DataFrame) -> DataFrame:
    """Counts per video that explain videos without an accepted window."""
    a = d.groupBy("video_id").agg(F.count("*").alias("total_samples"), F.count_if("is_talking").alias("talking_samples"))
    b = r.groupBy("video_id").agg(F.max(F.col("end") - F.col("start")).alias("longest_run"))
    c = w.groupBy("video_id").agg(F.count("*").alias("windows"), *(F.count_if(F.col("reject_reason") == x).alias(f"{x}_rejected") for x in ("presence", "cut", "face", "speech")), F.count_if(F.col("reject_reason").isNull()).alias("accepted"))
    out = a.join(b, "video_id", "left").join(c, "video_id", "left").na.fill(0)
    return out.where("accepted = 0").drop("accepted")


def annotations(clips: DataFrame, d: DataFrame, rules: Rules) -> DataFrame:
    """One row per clip: boxes of its track in [start, end) by time, with times from the (rounded) start."""
    c = clips.withColumns({"start": rounded(F.col("start"), 3), "bin": F.explode(F.sequence(F.floor(rounded(F.col("start"), 3) / rules.max_len), F.floor(F.col("end") / rules.max_len)))})
    x = d.withColumn("bin", F.floor(F.col("time_sec") / rules.max_len))
    met = c.select(*TRACK, "clip_filename", "start", "end", "bin").join(x, [*TRACK, "bin"]).where("start <= time_sec AND time_sec < end")
    box = F.struct(rounded(F.col("time_sec") - F.col("start"), 3).alias("time_sec"), F.col("time_sec").alias("source_time_sec"), "frame", F.array("x1", "y1", "x2", "y2").alias("bbox_xyxy"), "confidence", "is_talking")
    return met.groupBy(*TRACK, "clip_filename", "start", rounded(F.col("end") - F.col("start"), 3).alias("duration")).agg(F.sort_array(F.collect_list(box)).alias("boxes"))
