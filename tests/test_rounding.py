"""Ties of ratios and times, which doubles meet only nearly: as exact arithmetic says, and as the SQL says."""

import oracle
import pytest
from pyspark.sql import functions as F

from clipyard.functions import scalars as S
from clipyard.operators import clips
from clipyard.plans import media
from clipyard.plans import queries as q

VALUES = {"0.20375": 4, "0.47125": 4, "0.15125": 4, "0.65875": 4, "2.5": 0, "-0.00625": 4, "1234567.1235": 3, "2192471.5245": 3, "967.45": 1, "2042.45": 1}


def test_values_next_to_a_tie_round_up(spark):
    import duckdb
    from decimal import ROUND_HALF_UP, Decimal

    for text, digits in VALUES.items():
        want = float(Decimal(text).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
        for x in (float(text), float(text) * (1 + 2e-16), float(text) * (1 - 2e-16), float(text) - 1e-10):
            assert spark.range(1).select(S.rounded(F.lit(x), digits)).first()[0] == want
            assert duckdb.execute(f"SELECT {q.rounded('?::DOUBLE', digits)}", [x]).fetchone()[0] == want
    odd = [r[0] for r in spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(S.rounded(F.col("x"), 4)).collect()]
    assert odd[0] != odd[0] and odd[1:] == [float("inf"), None]


def test_a_ratio_as_large_as_its_least_is_accepted(spark):
    rules = clips.Rules(min_presence=0.1, min_face=0.2, min_speech=0.0005)
    w = spark.createDataFrame([(0.1, 0, 0.2 - 3e-17, 0.0005 - 1e-18), (0.1, 0, 0.2 - 1e-16, 0.0005), (0.1, 0, 0.19999, 0.0005)], "presence double, n_cuts int, face double, speech double")
    assert [r[0] for r in w.select(clips.gate(w, rules)).collect()] == [None, None, "face"]


def test_times_of_boxes_next_to_a_tie_round_up(spark):
    c = spark.createDataFrame([("v", 0, "000.mp4", 2192471.5244999997, 2192481.5)], "video_id string, track_id int, clip_filename string, start double, end double")
    d = spark.createDataFrame([("v", 0, t, i, 0.0, 0.0, 1.0, 1.0, 0.5, True) for i, t in enumerate((2192471.5245, 2192471.525, 2192480.1235))], "video_id string, track_id int, time_sec double, frame long, x1 double, y1 double, x2 double, y2 double, confidence double, is_talking boolean")
    got = clips.annotations(c, d, clips.Rules()).first()
    assert got["start"] == 2192471.525 and [(b["frame"], b["time_sec"]) for b in got["boxes"]] == [(1, 0.0), (2, 8.599)]
    later = clips.annotations(c.withColumn("start", F.lit(2192471.524)), d, clips.Rules()).first()
    assert [b["time_sec"] for b in later["boxes"]] == [0.001, 0.001, 8.6]


@pytest.fixture(scope="module")
def ties(spark, tmp_path_factory):
    """Events of videos whose clips have heights, speech, confidences, boxes and times next to ties."""
    import datetime
    import random

    rng = random.Random(6)
    rows = []
    for user in range(400):
        at = rng.randrange(0, 86400 * 10_000_000, 1000) // 10 * 10
        for _ in range(rng.choice([5, 6, 8, 10, 16])):
            at += rng.randrange(3600_000, 20_000_000) * 1000 + 500
            rows.append((len(rows), datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=at + 500), user, rng.choice(["purchase", "click", "view", "view"]), rng.choice([64.0, 66.7, 60.34, 62.95, rng.randrange(20000) / 100]), "{}"))
    path = str(tmp_path_factory.mktemp("ties"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["clip_metadata", "clip_metadata_file", "clip_annotations", "annotation_files"])
def test_ties_equal_sql(spark, ties, name):
    assert oracle.compare(oracle.connect(ties), (q.QUERIES | media.QUERIES)[name](spark, ties), (q.SQL | media.SQL)[name]) is None
