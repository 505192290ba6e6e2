import oracle
import pytest
from pyspark.sql import functions as F

from clipyard.operators.tracking import Tracker
from clipyard.functions import audio
from clipyard.functions import scalars as S
from clipyard.plans import media, skew
from clipyard.plans import queries as q
from clipyard.sources import tables
from clipyard.streaming import incremental

SF = "/root/testdata/sf0.001"


QUERIES, SQL = q.QUERIES | media.QUERIES | skew.QUERIES, q.SQL | media.SQL | skew.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert oracle.compare(oracle.connect(SF), QUERIES[name](spark, SF), SQL[name]) is None


def test_tracker_ties_gaps_and_thresholds():
    t = Tracker(2, 0.3)
    a, b = (0, 0, 10, 10), (100, 100, 110, 110)
    assert [t.take(0, a), t.take(0, b)] == [0, 1]
    assert t.take(2, a) == 0  # two samples later: the same
    assert t.take(2, a) == 2  # a track takes one box of a sample
    assert t.take(5, b) == 3  # three samples later: ended


def test_known_values(spark):
    row = spark.sql("SELECT '1:10:30-1:21:47' AS t, '1:24:7:41' AS u, 'https://youtu.be/frBTWyXiPF0?si=x' AS v").select(S.trim_bounds(S.F.col("t")), S.trim_bounds(S.F.col("u")), S.video_id(S.F.col("v"))).first()
    assert tuple(row[0]) == (4230.0, 4907.0, True) and row[1]["ok"] is False and row[2] == "frBTWyXiPF0"


def test_sound_round_trips():
    import numpy as np

    t = np.arange(8000) / 8000
    x = 0.5 * np.sin(2 * np.pi * 440 * t)
    got, rate = audio.decoded(audio.encoded(x, 8000, 1))
    assert rate == 8000 and np.abs(got - x).max() < 1e-4
    up = audio.resampled(x, 8000, 16000)
    want = 0.5 * np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert len(up) == 16000 and np.abs(up - want)[200:-200].max() < 5e-3
    centroid, roll, cross = audio.spectrum_of(want, 16000)
    assert 430 < centroid < 560 and 430 < roll < 460 and abs(cross - 880 / 16000) < 0.004
    assert audio.header(b"RIFF") is None and audio.header(None) is None and audio.decoded(b"RIFFxxxxWAVEfmt ") is None


def test_publish_and_flat_tables_read_back(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        tables.published(spark, path)
    assert tables.publish(d, path) == 1
    old = tables.published(spark, path)
    assert tables.publish(old.where("k = 2"), path) == 2 and [r["k"] for r in tables.published(spark, path).collect()] == [2]
    assert old.count() == 2  # a reader of the version before can finish
    assert tables.publish(d.limit(0), path) == 3 and tables.published(spark, path).count() == 0 and tables.versions(spark, path) == [2, 3]
    tables.write_flat(d, f"{tmp_path}/flat")
    csv = spark.read.option("header", True).csv(f"{tmp_path}/flat/csv")
    assert sorted((int(r["k"]), r["v"]) for r in csv.collect()) == [(1, "a"), (2, None)] and spark.read.parquet(f"{tmp_path}/flat/parquet").count() == 2


def test_readers_find_a_whole_table_while_others_are_published(spark, tmp_path):
    import threading

    path, failed, done = f"{tmp_path}/t", [], threading.Event()
    frames = [spark.range(n).withColumn("of", F.lit(n)) for n in (10, 20, 30, 40, 50)]
    tables.publish(frames[0], path)

    def read():
        while not done.is_set():
            try:
                r = tables.published(spark, path).agg(F.count("*").alias("n"), F.max("of").alias("of")).first()
                if r["n"] != r["of"]:
                    failed.append(r)
            except Exception as e:
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for f in frames[1:]:
        tables.publish(f, path, keep=5)
    done.set()
    reader.join()
    assert not failed


def test_a_publication_cut_off_leaves_no_version(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.publish(spark.range(3), path)
    with pytest.raises(Exception):
        tables.publish(spark.range(5).select(F.raise_error(F.lit("cut off")).alias("id")), path)
    assert tables.versions(spark, path) == [1] and tables.published(spark, path).count() == 3


def test_new_files_are_picked_up_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    run = lambda: incremental.pick_up(spark, str(source), "k int", f"{tmp_path}/out", f"{tmp_path}/seen", lambda b: b.distinct(), "k")
    (source / "a.json").write_text('{"k": 1}\n{"k": 2}\n')
    run()
    (source / "b.json").write_text('{"k": 2}\n{"k": 3}\n')
    run()
    run()
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_a_batch_cut_off_is_repeated_and_keys_stay_single(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"k": 1, "v": 2}\n{"k": 1, "v": 1}\n{"k": 2, "v": 5}\n')

    def fails(batch):
        return batch.withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("cut off"))).otherwise(F.col("v")))

    run = lambda job: incremental.pick_up(spark, str(source), "k int, v int", f"{tmp_path}/out", f"{tmp_path}/seen", job, "k")
    with pytest.raises(Exception):
        run(fails)
    assert not list((tmp_path / "out").glob("batch=*"))
    run(lambda b: b)
    run(lambda b: b)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 1), (2, 5)]


def test_large_manifest_with_braces_in_strings(spark, tmp_path):
    import json

    entries = {f"k{i} }}": {"key": '}{"\\' * (i % 4) + str(i), "splits": {"protocol_1_ood": "a}"}, "audio_manipulation": {"donor_clips": ["{", "}", "\\"][: i % 4]}} for i in range(60)}
    (tmp_path / "a.json").write_text(json.dumps(entries, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"one": {"key": "x", "splits": {}}}))
    (tmp_path / "c.json").write_text("{}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = {r["entry_key"]: (r["key"], r["audio_manipulation"] and r["audio_manipulation"]["donor_clips"]) for r in tables.large_manifest(spark, str(tmp_path), 5).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k: (e["key"], e["audio_manipulation"]["donor_clips"]) for k, e in entries.items()} | {"one": ("x", None)}


def test_timelines_are_read_from_nested_folders(spark, tmp_path):
    for name, frames in (("a", '[{"frame": 0, "time_sec": 0.0, "boxes": [{"bbox_xyxy": [1, 2, 3, 4], "confidence": 0.9}]}, {"frame": 5, "time_sec": 0.2, "boxes": []}]'), ("b", "[]")):
        (tmp_path / name / "x").mkdir(parents=True)
        (tmp_path / name / "x" / "detections.json").write_text(f'{{"source_video": "{name}", "frames": {frames}}}')
    got = tables.flattened(tables.timelines(spark, str(tmp_path))).orderBy("video_id", "sample_idx").collect()
    assert [(r["video_id"], r["sample_idx"], r["x1"]) for r in got] == [("a", 0, 1.0), ("a", 1, None), ("b", None, None)]
