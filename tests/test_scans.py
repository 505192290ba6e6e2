"""Ordered scans, interval joins, suppression, tracks and drawn places against plain versions."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from clipyard.operators import clips, intervals, splits, stats, tracking
from clipyard.operators.scans import Scan, numbered, ordered


def _plain(rows):
    """By key, in order: sum, sum before, max, max before, last, last before, next, next after, of values that may be null."""
    out = {}
    for key in {k for k, _, _ in rows}:
        own = sorted(((t, v) for k, t, v in rows if k == key), key=lambda r: r[0])
        vs = [v for _, v in own]
        some = lambda xs: [x for x in xs if x is not None]
        for i, (t, _) in enumerate(own):
            a, b, c, d = some(vs[: i + 1]), some(vs[:i]), some(vs[i:]), some(vs[i + 1 :])
            out[key, t] = (sum(a), sum(b), max(a, default=None), max(b, default=None), a[-1] if a else None, b[-1] if b else None, c[0] if c else None, d[0] if d else None, sum(c))
    return out


@pytest.mark.parametrize("most,ranges", [(10**9, None), (0, 23)])
def test_scans_whatever_the_ranges(spark, most, ranges):
    rng = random.Random(1)
    rows = [(rng.choice(["a"] * 7 + ["b", "c", None]), t, rng.choice([None, None, 1, 2, 5, -3])) for t in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    v = F.col("v")
    scans = {"s": Scan("sum", v), "s0": Scan("sum", v, own=False), "m": Scan("max", v), "m0": Scan("max", v, own=False), "l": Scan("last", v), "l0": Scan("last", v, own=False), "n": Scan("last", v, back=True), "n0": Scan("last", v, own=False, back=True), "b": Scan("sum", v, back=True)}
    held = ordered(df, ["k"], ["t"], most, ranges)
    assert held.cut == (most < 200)
    assert {(r["k"], r["t"]): tuple(r[c] for c in scans) for r in held.scan(**scans).result().collect()} == _plain(rows)
    places = {}
    for r in numbered(df, ["k"], ["t"], "place", most, ranges).collect():
        places.setdefault(r["k"], []).append((r["t"], r["place"]))
    assert all([p for _, p in sorted(x)] == list(range(len(x))) for x in places.values())


def test_a_large_key_is_spread_and_carries_are_few(spark):
    df = spark.range(20_000).select(F.lit("large").alias("k"), F.col("id").alias("t"))
    held = ordered(df, ["k"], ["t"], most=1000, ranges=8)
    sizes = [r["n"] for r in held.rows.groupBy("range_").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 5000
    last = held.scan(n=Scan("sum", F.lit(1))).result().agg(F.max("n"), F.count_distinct("n")).first()
    assert tuple(last) == (20_000, 20_000)


@pytest.mark.parametrize("most", [10**9, 0])
def test_no_scan_goes_through_the_rest_for_each_row(spark, most):
    df = spark.range(3000).select(F.lit("large").alias("k"), F.col("id").alias("t"))
    back = ordered(df, ["k"], ["t"], most).scan(n=Scan("last", F.col("t"), own=False, back=True), s=Scan("sum", F.lit(1), back=True)).result()
    assert "unboundedfollowing" not in back._jdf.queryExecution().toString().lower()
    assert all((r["n"], r["s"]) == (r["t"] + 1 if r["t"] < 2999 else None, 3000 - r["t"]) for r in back.collect())


@pytest.mark.parametrize("longest", [None, 900.0])
def test_overlaps_of_mixed_lengths(spark, longest):
    rng = random.Random(2)
    some = lambda n, lengths: [(rng.choice("ab"), i, s := rng.uniform(0, 1000), s + rng.choice(lengths) * rng.random()) for i in range(n)]
    one, two = some(90, [1, 3, 10, 100, 900]), some(90, [0, 0, 1, 3, 10, 100, 5000])
    got = intervals.overlapping(spark.createDataFrame(one, "k string, x int, start double, end double"), spark.createDataFrame(two, "k string, y int, s double, e double"), ["k"], 5.0, longest).select("x", "y").collect()
    assert sorted(map(tuple, got)) == sorted((a[1], b[1]) for a in one for b in two if a[0] == b[0] and b[2] < a[3] and b[3] > a[2])


@pytest.mark.parametrize("most", [None, 50])
def test_coverage_and_cuts_of_windows_that_meet_many(spark, most):
    rng = random.Random(8)
    some = lambda n, longest: [(rng.choice(["a", "a", "b", None]), s := float(rng.randrange(60)), s + rng.randrange(longest)) for _ in range(n)]
    one = [r for r in some(300, 30) if r[1] < r[2]] + [("a", 10.0, 20.0)] * 2 + [("c", 1.0, 2.0)]
    two = some(300, 40) + [("a", 5.0, 3.0), ("a", None, 3.0), ("a", 4.0, None)]
    w = spark.createDataFrame(one, "k string, start double, end double")
    met = lambda r: [i for i in two if r[0] is not None and i[0] == r[0] and None not in i and i[1] < i[2] and i[1] < r[2] and i[2] > r[1]]
    got = intervals.dense_coverage(w, spark.createDataFrame(two, "k string, s double, e double"), ["k"], most).collect()
    want = [(*r, sum(min(r[2], e) - max(r[1], s) for _, s, e in met(r)) / (r[2] - r[1])) for r in one]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    n = intervals.cuts_inside(w, spark.createDataFrame([i[:2] for i in two], "k string, cut double"), ["k"], most).collect()
    inside = {r: sum(r[0] is not None and i[0] == r[0] and i[1] is not None and r[1] < i[1] < r[2] for i in two) for r in one}
    assert {tuple(r)[:3]: r["n_cuts"] for r in n} == {r: c for r, c in inside.items() if c} and len(n) == len({r for r, c in inside.items() if c})


def test_a_short_window_under_very_many_long_intervals(spark):
    d = spark.range(400_000).select(F.lit("a").alias("k"), (F.col("id") / 1e6).alias("s"), (F.col("id") / 1e6 + 1e7).alias("e"))
    w = spark.createDataFrame([("a", 2192471.524513, 2192472.524513), ("a", 0.1, 5e5)], "k string, start double, end double")
    got = {r["start"]: r["covered"] for r in intervals.dense_coverage(w, d, ["k"]).collect()}
    secs = sum(5e5 - max(0.1, i / 1e6) for i in range(400_000))
    assert got[2192471.524513] == 400_000 and abs(got[0.1] - secs / (5e5 - 0.1)) < 1e-6
    points = intervals.cuts_inside(w, d.select("k", F.col("e").alias("cut")), ["k"])
    assert points.isEmpty() and "unboundedfollowing" not in points._jdf.queryExecution().toString().lower()


def test_a_long_interval_takes_few_rows(spark):
    year = spark.createDataFrame([("a", 0.0, 3.2e7)], "k string, start double, end double").withColumns({"a_": F.col("start"), "b_": F.col("end"), "l_": intervals.level_of(F.col("end") - F.col("start"), 10.0)})
    assert intervals._placed(year, list(range(30)), (0,), (1,), 10.0).count() <= 2 * 30


@pytest.mark.parametrize("in_array,most", [(10**6, None), (25, 0)])
def test_suppression_by_plain_greed(spark, in_array, most):
    rng = random.Random(3)
    rows = []
    for track in range(3):
        for i in range(50):
            s = rng.uniform(0, 300 if track else 60)
            rows.append(("v", track, i, s, s + rng.choice([1, 2, 8, 30]) * (0.2 + rng.random()), rng.randrange(12)))
    rows += [("w", 0, i, float(i), i + 1.0, 5) for i in range(20)] + [("x", 0, i, i * 1.0, i + 1.5, i) for i in range(40)]
    want, kept = set(), {}
    for v, t, i, s, e, c in sorted(rows, key=lambda r: (-r[5], r[3], r[2])):
        if not any(a < e and s < b for a, b in kept.get((v, t), [])):
            kept.setdefault((v, t), []).append((s, e))
            want.add((v, t, i))
    df = spark.createDataFrame(rows, "video_id string, track_id int, i int, start double, end double, c int")
    got = clips.suppressed(df, [-F.col("c"), F.col("start"), F.col("i")], in_array, most)
    assert {(r["video_id"], r["track_id"], r["i"]) for r in got.collect()} == want and got.columns == df.columns


@pytest.mark.parametrize("in_array,most,block", [(5, 0, 3), (1, None, 20)])
def test_suppression_in_rounds_of_the_best(spark, monkeypatch, in_array, most, block):
    monkeypatch.setattr(clips, "suppressed", functools.partial(clips.suppressed, block=block))
    test_suppression_by_plain_greed(spark, in_array, most)


def test_a_long_chain_of_falling_ranks_takes_few_rounds(spark, monkeypatch):
    """Each window overlaps the next one, which is worse: rounds of local maxima would be as many as windows."""
    written = []
    monkeypatch.setattr(clips, "scratch", lambda df, name, f=clips.scratch: (written.append(name), f(df, name))[1])
    w = spark.range(400).select(F.lit("v").alias("video_id"), F.lit(0).alias("track_id"), "id", (F.col("id") * 1.0).alias("start"), (F.col("id") + 1.5).alias("end"))
    got = clips.suppressed(w, [F.col("id")], in_array=10, block=50)
    assert sorted(r["id"] for r in got.collect()) == list(range(0, 400, 2)) and written.count("ranked") <= 4


@pytest.mark.parametrize("samples,warm,most", [(20, 10, 0), (6, 0, None)])
def test_tracks_in_slices_equal_one_tracker(spark, samples, warm, most):
    rng = random.Random(4)
    rows = []
    for video, n, jump, grid in (("a", 120, 8, 1e-6), ("b", 90, 30, 10), ("c", 100, 3, 25)):
        at = [(i * 60.0, 0.0) for i in range(4)]
        for s in range(n):
            for b, (x, y) in enumerate(at):
                if rng.random() < 0.2:
                    continue
                at[b] = (x + rng.uniform(-jump, jump), y + rng.uniform(-jump, jump))
                x, y = (float(round(v / grid) * grid) for v in at[b])
                rows.append((video, s, b, x, y, x + 50, y + 50, rng.choice([0.5, 0.6, 0.9])))
    want = {}
    for video in "abc":
        one = tracking.Tracker(2, 0.3)
        for r in sorted((r for r in rows if r[0] == video), key=lambda r: (r[1], -r[7], r[2])):
            want[video, r[1], r[2]] = one.take(r[1], tuple(r[3:7]))
    d = spark.createDataFrame(rows, "video_id string, sample_idx int, box_idx int, x1 double, y1 double, x2 double, y2 double, confidence double")
    assert {(r["video_id"], r["sample_idx"], r["box_idx"]): r["track_id"] for r in tracking.iou_tracks(d, 2, 0.3, samples, warm, most).collect()} == want


def test_what_slices_start_with_is_not_written_for_each_row(spark, tmp_path, monkeypatch):
    """Many boxes a sample at equal places, so that slices are tracked again: what is written grows with the rows, and boxes at one place are compared once."""
    rng = random.Random(9)
    places = [(x * 250.0, y * 250.0) for x in range(4) for y in range(2)]
    rows = [("v", s, s * 150 + b, *(p := rng.choice(places)), p[0] + 600, p[1] + 600, rng.randrange(100) / 100) for s in range(60) for b in range(150)]
    calls = []
    monkeypatch.setattr(tracking, "box_iou", lambda a, b, f=tracking.box_iou: (calls.append(1), f(a, b))[1])
    one, want = tracking.Tracker(2, 0.3), {}
    for r in sorted(rows, key=lambda r: (r[1], -r[7], r[2])):
        want[r[2]] = one.take(r[1], tuple(r[3:7]))
    assert len(calls) <= len(rows) * len(places)
    monkeypatch.undo()
    d = spark.createDataFrame(rows, "video_id string, sample_idx int, box_idx int, x1 double, y1 double, x2 double, y2 double, confidence double")
    seen, kind = [], type(d)
    monkeypatch.setattr(kind, "mapInPandas", lambda self, *a, f=kind.mapInPandas: (seen.append(self), f(self, *a))[1])
    assert {r["box_idx"]: r["track_id"] for r in tracking.iou_tracks(d, 2, 0.3, 10, 5).collect()} == want
    again = [x for x in seen if "taken" in x.columns]
    assert again and all(x.where("taken IS NOT NULL").count() <= 6 for x in again)


def test_places_are_drawn_evenly_and_once(spark):
    got = [r["p"] for r in spark.range(6000).select(splits.places(F.lit(5), 3, F.lit("7"), F.col("id").cast("string")).alias("p")).collect()]
    assert all(len(set(p)) == 3 and set(p) <= set(range(5)) for p in got)
    for t in range(3):
        assert all(abs(sum(p[t] == x for p in got) - 1200) < 150 for x in range(5))
    few = spark.range(2).select(splits.places(F.col("id"), 3, F.lit("7")).alias("p")).orderBy("id").collect()
    assert few[0]["p"] is None and few[1]["p"] == [0]


def test_donors_are_of_another_video_of_the_group(spark):
    rows = [(f"p{v % 2}", "q", f"v{v}", f"k{v}_{i}", f"a/{v}/{i}") for v in range(7) for i in range(1 + v)] + [("lone", "q", "w", "k", "a/w"), (None, "q", "n1", "n1", "a/n1"), (None, "q", "n2", "n2", "a/n2")]
    got = splits.assign_donors(spark.createDataFrame(rows, "p1 string, p2 string, video_id string, key string, audio_path string"), 11, 3, 0).collect()
    group, size = {r[2]: r[0] for r in rows}, {}
    for r in rows:
        size[r[2]] = size.get(r[2], 0) + 1
    assert len(got) == len(rows)
    for r in got:
        if r["p1"] == "lone":
            assert r["donor_video_id"] is None and r["donor_audio_paths"] == []
            continue
        d = r["donor_video_id"]
        assert d != r["video_id"] and group[d] == r["p1"] and len(set(r["donor_audio_paths"])) == min(3, size[d]) and all(p.split("/")[1] in d for p in r["donor_audio_paths"])


def test_quartiles_with_many_equal_values(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([0.1, 0.2, 0.2, 0.7, 3.0, None])) for g in "ab" for _ in range(301)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in stats.box_stats(df, ["g"], "x", most=1).collect()}
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).collect()}
    assert all([round(v, 9) for v in (got[g]["q1"], got[g]["median"], got[g]["q3"])] == [round(v, 9) for v in want[g]] for g in "abc") and got["c"]["outliers"] == 0


def test_density_of_many_bins_equals_the_direct_sum(spark):
    import numpy as np

    df = spark.range(100_000).select((F.col("id") % 2).alias("g"), (F.pow((F.col("id") % 50_000) / 50_000.0, F.lit(2.0)) * 1000 + F.col("id") / 1e5).alias("x"))
    for g, of in df.toPandas().groupby("g"):
        x = of["x"].to_numpy()
        v, m = np.unique(np.round(x / 0.001) * 0.001, return_counts=True)
        h = x.std(ddof=1) * len(x) ** -0.2
        got = stats.density(df.where(F.col("g") == g), "g", "x", 0.001).orderBy("i").select("at", "density").toPandas()
        want = [(m * np.exp(-(((at - v) / h) ** 2) / 2)).sum() / len(x) / h / np.sqrt(2 * np.pi) for at in got["at"]]
        assert len(v) > 40_000 and np.abs(got["density"] - want).max() < 1e-8
