"""Greedy IoU tracker over videos of any length.

A stretch of a video, between gaps in which all tracks end, is cut into slices of some samples, and all slices are
tracked at once. A slice first runs over the last samples before it, from nothing: the tracks that live after these are
what it takes for handed over. Then the slices' ends are held against that, in order: what a slice has taken is as good
as known where it equals what the slice before it really left. Where it does not, the slice and those after it are
tracked again from what was left, until they meet what was taken before. So the result is that of one tracker over the
whole stretch, and only summaries of slices are gone through one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from clipyard.operators.scans import Scan, ordered
from clipyard.sources.tables import scratch

#: Samples of a slice, and of the run before it; rounds in which slices are tracked again before the rest of a stretch is taken as a whole.
SLICE, WARM, ROUNDS = 2000, 50, 4
BOX = ["x1", "y1", "x2", "y2"]


def box_iou(a, b) -> float:
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = sum(max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1]) for x in (a, b)) - inter
    return inter / union if union > 0 else 0.0


class Tracker:
    """Tracks of one stretch or slice. A track ends max_gap samples after its last box; of equal overlaps the younger track is taken; a track begun in a sample takes no second box of it.

    start: (last sample, box) of tracks handed over, oldest first. They are -1, -2, ... from the youngest; new ones 0, 1, ...
    """

    def __init__(self, max_gap: int, min_iou: float, start: list[tuple[int, tuple]] = ()):
        self.max_gap, self.min_iou = max_gap, min_iou
        self.live: dict[int, tuple[int, tuple]] = {i - len(start): x for i, x in enumerate(start)}
        self.now, self.free, self.born, self.tied = None, {}, 0, False

    def take(self, sample: int, box: tuple) -> int:
        """The track of the next box; boxes come by sample, confidence (descending), box_idx."""
        if sample != self.now:
            self.now = sample
            self.live = {t: v for t, v in self.live.items() if sample - v[0] <= self.max_gap}
            self.free = {}  # tracks by their box, the youngest last: equal boxes are compared once
            for t in sorted(self.live):
                self.free.setdefault(self.live[t][1], []).append(t)
        overlap, track, held, equal = -1.0, -1, None, False
        for other, tracks in self.free.items():
            o = box_iou(other, box)
            if o > overlap:
                overlap, track, held, equal = o, tracks[-1], other, len(tracks) > 1
            elif o == overlap:
                equal = True
                if tracks[-1] > track:
                    track, held = tracks[-1], other
        if overlap < self.min_iou:
            track, self.born = self.born, self.born + 1
        else:
            self.tied = self.tied or equal
            self.free[held].pop()
            if not self.free[held]:
                del self.free[held]
        self.live[track] = (sample, box)
        return track

    def left(self, sample: int) -> list[tuple[int, int, tuple]]:
        """(track, last sample, box) of those that live at the sample, oldest first."""
        return sorted((t, last, box) for t, (last, box) in self.live.items() if sample - last <= self.max_gap)


SUMMARY = "struct<start:array<struct<last:bigint,box:array<double>>>,left:array<struct<own:int,last:bigint,box:array<double>>>,born:int,tied:boolean>"
KEY = ["video_id", "segment"]
ORDER = ["sample_idx", "confidence", "box_idx"]


def _summary(start: list, tracker: Tracker, end: int) -> dict:
    return {"start": [{"last": s, "box": list(b)} for s, b in start], "left": [{"own": t, "last": s, "box": list(b)} for t, s, b in tracker.left(end)], "born": tracker.born, "tied": tracker.tied}


def _pairs(held) -> list[tuple[int, tuple]]:
    return [(int(x["last"]), tuple(map(float, x["box"]))) for x in held]


class _Slices:
    """Tracks slices that come one after another; gives own numbers for rows, and a summary for each slice."""

    def __init__(self, max_gap: int, min_iou: float, samples: int):
        self.max_gap, self.min_iou, self.samples = max_gap, min_iou, samples

    def run(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each slice from the rows before it (`warm`), from nothing."""
        key, tracker, started, start, first, columns = None, None, False, [], 0, []

        def closed() -> list[dict]:
            return [{"video_id": key[0], "segment": key[1], "slice": key[2], "summary": _summary(start, tracker, first + self.samples)}] if started else []

        for pdf in batches:
            own, ends, columns = [], [], [*pdf.columns, "own", "summary"]
            for video, segment, slice_, base, warm, sample, *box in pdf[[*KEY, "slice", "base", "warm", "sample_idx", *BOX]].itertuples(index=False):
                if (video, segment, slice_) != key:
                    if key is not None:
                        ends += closed()
                    key, tracker, started, start, first = (video, segment, slice_), Tracker(self.max_gap, self.min_iou), False, [], base + slice_ * self.samples
                if not warm and not started:
                    started, start = True, [(s, b) for _, s, b in tracker.left(first)]
                    tracker = Tracker(self.max_gap, self.min_iou, start)
                own.append(tracker.take(sample, tuple(box)))
            yield pdf.assign(own=own, summary=None)[~pdf["warm"].astype(bool)]
            if ends:
                yield pd.DataFrame(ends).reindex(columns=columns)
        if key is not None and started:
            yield pd.DataFrame(closed()).reindex(columns=columns)

    def again(self, batches: Iterator[pd.DataFrame], to_end: bool) -> Iterator[pd.DataFrame]:
        """Slices in order from the first one of each stretch, which starts with `known`; stops where a slice's `taken` start equals what is left, unless to_end. Both are in a row of their own (`head`) before those of the slice."""
        key, slice_now, tracker, start, first, on, columns, heads = None, None, None, [], 0, False, [], ([], [])

        def closed() -> list[dict]:
            return [{"video_id": key[0], "segment": key[1], "slice": slice_now, "summary": _summary(start, tracker, first + self.samples)}]

        for pdf in batches:
            own, keep, ends = [], [], []
            columns = [*pdf.columns.drop(["head", "known", "taken"]), "own", "summary"]
            for video, segment, slice_, base, sample, x1, y1, x2, y2, head, known, taken in pdf[[*KEY, "slice", "base", "sample_idx", *BOX, "head", "known", "taken"]].itertuples(index=False):
                if head:
                    heads = [] if known is None else _pairs(known), _pairs(taken)
                    keep.append(False)
                    own.append(0)
                    continue
                if (video, segment) != key or slice_ != slice_now:
                    if on:
                        ends += closed()
                    new, at = (video, segment) != key, base + slice_ * self.samples
                    if new:
                        start, on = heads[0], True
                    elif on:
                        start = [(s, b) for _, s, b in tracker.left(at)]
                        on = to_end or start != heads[1]
                    key, slice_now, first = (video, segment), slice_, at
                    tracker = Tracker(self.max_gap, self.min_iou, start)
                keep.append(on)
                own.append(tracker.take(sample, (x1, y1, x2, y2)) if on else 0)
            yield pdf.assign(own=own, summary=None)[columns][keep]
            if ends:
                yield pd.DataFrame(ends).reindex(columns=columns)
        if key is not None and on:
            yield pd.DataFrame(closed()).reindex(columns=columns)

    def handed(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Goes through summaries in order: `ids` of the tracks handed over to each slice and the number before its own (`before`), or, at the first slice of a stretch that took what was not left, `known`: what was."""
        key, truth, born, lost = None, [], 0, False
        for pdf in batches:
            out = []
            for video, segment, slice_, s in pdf[[*KEY, "slice", "summary"]].itertuples(index=False):
                if (video, segment) != key:
                    key, truth, born, lost = (video, segment), [], 0, False
                if lost:
                    continue
                start, real = _pairs(s["start"]), [(last, box) for _, last, box in truth]
                same = start == real or not s["tied"] and len(set(real)) == len(real) and sorted(start) == sorted(real)
                if not same:
                    lost = True
                    out.append({"video_id": video, "segment": segment, "slice": slice_, "ids": None, "before": None, "known": [{"last": a, "box": list(b)} for a, b in real]})
                    continue
                of = {} if start == real else {(last, box): i for i, last, box in truth}
                ids = [of[x] for x in start] if of else [i for i, _, _ in truth]
                out.append({"video_id": video, "segment": segment, "slice": slice_, "ids": ids, "before": born, "known": None})
                truth = sorted((born + x["own"] if x["own"] >= 0 else ids[len(ids) + x["own"]], int(x["last"]), tuple(map(float, x["box"]))) for x in s["left"])
                born += int(s["born"])
            yield pd.DataFrame(out, columns=[*KEY, "slice", "ids", "before", "known"])


def iou_tracks(d: DataFrame, max_gap: int = 2, min_iou: float = 0.30, samples: int = SLICE, warm: int = WARM, most: int | None = None) -> DataFrame:
    """d (video_id, sample_idx, box_idx, x1..y2, confidence) with track_id, dense from 0 in each video in order of creation. samples, warm: of a slice, and of the run before it; they change no result."""
    if samples <= max_gap or warm > samples:
        raise ValueError("a slice must be longer than a gap, and no shorter than the run before it")
    seen = ordered(d, ["video_id"], ["sample_idx", "box_idx"], most).scan(before_=Scan("last", F.col("sample_idx"), own=False))
    new = F.col("before_").isNull() | (F.col("sample_idx") - F.col("before_") > max_gap)
    seen = seen.with_columns(new_=new.cast("int"), base_=F.when(new, F.col("sample_idx"))).scan(segment=Scan("sum", F.col("new_")), base=Scan("last", F.col("base_")))
    rows = seen.result().drop("before_", "new_", "base_").withColumn("slice", F.floor((F.col("sample_idx") - F.col("base")) / samples))
    rows = rows.withColumns({"segment": F.col("segment").cast("long"), "base": F.col("base").cast("long")})
    at = F.col("base") + (F.col("slice") + 1) * samples
    both = F.array(F.struct(F.col("slice").alias("slice"), F.lit(False).alias("warm")), F.struct((F.col("slice") + 1).alias("slice"), F.lit(True).alias("warm")))
    copies = F.when(F.col("sample_idx") >= at - warm, both).otherwise(F.slice(both, 1, 1))
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    tracker = _Slices(max_gap, min_iou, samples)
    within = ["sample_idx", F.desc("confidence"), "box_idx"]

    sliced = rows.withColumn("c", F.explode(copies)).withColumns({"slice": F.col("c.slice"), "warm": F.col("c.warm")}).drop("c")
    dealt = sliced.repartition(*KEY, "slice").sortWithinPartitions(*KEY, "slice", *within)
    tracked = scratch(dealt.mapInPandas(tracker.run, f"{plain}, warm boolean, own int, summary {SUMMARY}").drop("warm"), "tracks")
    for turn in range(ROUNDS + 2):
        summaries = tracked.where("summary IS NOT NULL").select(*KEY, "slice", "summary")
        in_order = summaries.repartition(*KEY).sortWithinPartitions(*KEY, "slice")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in summaries.drop("summary").schema.fields)
        told = scratch(in_order.mapInPandas(tracker.handed, f"{schema}, ids array<bigint>, before bigint, known array<struct<last:bigint,box:array<double>>>"), "handed")
        lost = told.where("known IS NOT NULL").select(*KEY, F.col("slice").alias("from_"), "known")
        if lost.isEmpty():
            break
        # What slices start with may be thousands of boxes, so it stands in one row a slice. Numbers in it are 0, since pandas reads a column of integers with nulls as floats.
        rest = rows.join(lost.select(*KEY, "from_"), KEY).where("slice >= from_").drop("from_")
        heads = summaries.join(lost, KEY).where("slice >= from_").select(*KEY, "slice", F.lit(True).alias("head"), F.when(F.col("slice") == F.col("from_"), F.col("known")).alias("known"), F.col("summary.start").alias("taken"))
        blank = {f.name: F.lit(0).cast(f.dataType) for f in rest.schema.fields if isinstance(f.dataType, NumericType) and f.name not in heads.columns}
        headed = rest.withColumn("head", F.lit(False)).unionByName(heads.withColumns(blank), allowMissingColumns=True)
        rerun = headed.repartition(*KEY).sortWithinPartitions(*KEY, "slice", F.desc("head"), *within)
        to_end = turn >= ROUNDS
        again = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
        found = scratch(rerun.mapInPandas(lambda b, to_end=to_end: tracker.again(b, to_end), f"{again}, own int, summary {SUMMARY}").select(*tracked.columns), "tracks")
        done = found.select(*KEY, "slice").distinct()
        tracked = scratch(tracked.join(done, [*KEY, "slice"], "left_anti").unionByName(found), "tracks")
    ids = told.select(*KEY, "slice", F.size("ids").alias("n_"), F.posexplode("ids").alias("i_", "id_")).select(*KEY, "slice", (F.col("i_") - F.col("n_")).alias("own"), "id_")
    own = tracked.where("summary IS NULL").drop("summary").join(told.select(*KEY, "slice", "before"), [*KEY, "slice"]).join(ids, [*KEY, "slice", "own"], "left")
    own = own.withColumn("own", F.when(F.col("own") >= 0, F.col("before") + F.col("own")).otherwise(F.col("id_")))
    ends = tracked.where("summary IS NOT NULL").groupBy(*KEY).agg(F.sum("summary.born").alias("n"))
    before = F.sum("n").over(Window.partitionBy("video_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ends.select(*KEY, F.coalesce(before, F.lit(0)).alias("offset"))
    return own.join(offsets, KEY).withColumn("track_id", (F.col("own") + F.col("offset")).cast("int")).select(*d.columns, "track_id")
