"""Registered queries on sound, probes, files and manifests, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipyard.functions import audio, labels
from clipyard.functions import scalars as S
from clipyard.operators import clips, metadata, sound, stats
from clipyard.plans import queries as q
from clipyard.sources import sinks, tables
from clipyard.sources.tables import table

QUERIES, SQL = {}, {}
METHOD_NAMES = {k: v for k, v in labels.METHODS.items() if k != "real"}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{tables.shared_dir(spark).rstrip('/')}/{name}-{q.unique()}"


# --- sound --------------------------------------------------------------------------------------


def sound_files(spark: SparkSession, d: str) -> DataFrame:
    """WAV files made of the embeddings: one or two channels, three rates, every eleventh cut off in its header."""
    k = F.col("vec_id")
    rate, channels = F.lit(8000) + k % 3 * 4000, F.lit(1) + k % 2
    data = audio.wav_file("embedding", rate, channels)
    return table(spark, d, "embeddings").select(k, F.when(k % 11 == 0, F.substring(data, F.lit(1), F.lit(30))).otherwise(data).alias("content"), rate.alias("rate"))


@query("SELECT vec_id, CASE WHEN vec_id % 11 > 0 THEN round((len(embedding) // (1 + vec_id % 2)) / (8000 + vec_id % 3 * 4000)::DOUBLE, 8) END AS duration, CAST(CASE WHEN vec_id % 11 > 0 THEN 8000 + vec_id % 3 * 4000 END AS INT) AS sample_rate, CAST(CASE WHEN vec_id % 11 > 0 THEN 1 + vec_id % 2 END AS INT) AS channels FROM embeddings")
def audio_info(spark: SparkSession, d: str) -> DataFrame:
    return sound_files(spark, d).withColumn("i", audio.audio_info("content")).select("vec_id", F.round("i.duration", 8).alias("duration"), "i.sample_rate", "i.channels")


PCM = "p AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(-32768, least(32767, floor(CAST(x AS DOUBLE) * 32768 + 0.5))) / 32768) AS e FROM embeddings), w AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN e ELSE list_transform(range(0, len(e) // 2), lambda i: (e[2 * i + 1] + e[2 * i + 2]) / 2) END AS e FROM p)"


@query(f"WITH {PCM} SELECT vec_id, len(e) AS n, round(e[1], 6) AS first_sample, round(list_sum(list_transform(e, lambda x: abs(x))), 4) AS total FROM w")
def decode_waveforms(spark: SparkSession, d: str) -> DataFrame:
    """Files at the rate wanted, mixed down."""
    wave = audio.waveform(audio.wav_file("embedding", F.lit(audio.RATE), F.lit(1) + F.col("vec_id") % 2))
    w = table(spark, d, "embeddings").withColumn("w", wave)
    return w.select("vec_id", F.size("w").cast("long").alias("n"), F.round(F.get("w", F.lit(0)).cast("double"), 6).alias("first_sample"), F.round(S.sum_of(F.transform("w", lambda x: F.abs(x.cast("double")))), 4).alias("total"))


#: Samples as each format holds them, and the kernel of resampling: a sinc over LOBES zeros on either side, under a squared cosine.
FORMATS = "f AS (SELECT vec_id, list_transform(embedding, lambda x: CASE vec_id % 5 WHEN 0 THEN greatest(-128, least(127, floor(CAST(x AS DOUBLE) * 128 + 0.5))) / 128 WHEN 1 THEN greatest(-8388608, least(8388607, floor(CAST(x AS DOUBLE) * 8388608 + 0.5))) / 8388608 WHEN 2 THEN greatest(-2147483648, least(2147483647, floor(CAST(x AS DOUBLE) * 2147483648 + 0.5))) / 2147483648 ELSE CAST(x AS DOUBLE) END) AS e FROM embeddings)"
KERNEL = f"""r AS (SELECT vec_id, e, 8000 + vec_id % 3 * 4000 AS rate, (8000 + vec_id % 3 * 4000) / 16000.0::DOUBLE AS ratio FROM f),
o AS (SELECT *, unnest(range(0, CAST(ceil(len(e) / ratio) AS BIGINT))) AS a, {audio.KEPT}::DOUBLE AS band, CAST(ceil({audio.LOBES} / {audio.KEPT}::DOUBLE) AS BIGINT) AS reach FROM r WHERE rate < 16000),
p AS (SELECT vec_id, a, e, a * rate // 16000 AS w, (a * rate % 16000) / 16000.0::DOUBLE AS part, band, unnest(range(-reach, reach + 1)) AS tap FROM o),
t AS (SELECT vec_id, a, CASE WHEN w + tap BETWEEN 0 AND len(e) - 1 THEN e[w + tap + 1] ELSE 0 END AS x, greatest(-{audio.LOBES}, least({audio.LOBES}, (tap - part) * band)) AS z, band FROM p),
q AS (SELECT vec_id, a, CAST(sum(x * CASE WHEN z = 0 THEN 1 ELSE sin(pi() * z) / (pi() * z) END * pow(cos(z * pi() / {audio.LOBES} / 2), 2) * band) AS FLOAT) AS x FROM t GROUP BY ALL
UNION ALL SELECT vec_id, a, CAST(e[a + 1] AS FLOAT) FROM (SELECT vec_id, e, unnest(range(0, len(e))) AS a FROM r WHERE rate = 16000))"""


@query(f"WITH {FORMATS}, {KERNEL} SELECT vec_id, a AS place, round(CAST(x AS DOUBLE), 4) AS sample FROM q")
def decode_formats(spark: SparkSession, d: str) -> DataFrame:
    """Files of 8, 24 and 32 bits and of floats, at 8, 12 and 16 kHz: every sample at the rate wanted."""
    k = F.col("vec_id")
    bits = F.element_at(F.array(*map(F.lit, (8, 24, 32, 32, 64))), (k % 5 + 1).cast("int"))
    wave = audio.waveform(audio.wav_file_of("embedding", F.lit(8000) + k % 3 * 4000, bits, k % 5 > 2))
    return table(spark, d, "embeddings").select(k, F.posexplode(wave).alias("place", "x")).select("vec_id", F.col("place").cast("long").alias("place"), F.round(F.col("x").cast("double"), 4).alias("sample"))


JOINED = """n AS (SELECT label, embedding, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 40 AS part FROM embeddings),
w AS (SELECT label, part, list_transform(flatten(list(embedding ORDER BY vec_id)), lambda x: CAST(x AS DOUBLE)) AS e FROM n GROUP BY ALL),
fr AS (SELECT *, unnest(range(0, len(e) // 512 + 1)) AS j FROM w),
fx AS (SELECT label, part, j, list_transform(range(0, 2048), lambda i: CASE WHEN j * 512 - 1024 + i BETWEEN 0 AND len(e) - 1 THEN e[j * 512 - 1024 + i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 2048)) ELSE 0 END) AS x,
  list_transform(range(0, 2048), lambda i: e[greatest(1, least(len(e), j * 512 - 1024 + i + 1))]) AS y FROM fr),
tw AS (SELECT k, list_transform(range(0, 2048), lambda i: cos(2 * pi() * (k * i % 2048) / 2048)) AS c, list_transform(range(0, 2048), lambda i: sin(2 * pi() * (k * i % 2048) / 2048)) AS s FROM range(0, 1025) t(k)),
m AS (SELECT label, part, j, k, sqrt(pow(list_inner_product(x, c), 2) + pow(list_inner_product(x, s), 2)) AS s FROM fx, tw),
c AS (SELECT *, sum(s) OVER (PARTITION BY label, part, j ORDER BY k) AS so_far, sum(s) OVER (PARTITION BY label, part, j) AS total FROM m),
f AS (SELECT label, part, j, sum(k * s) / sum(s) * 16000 / 2048 AS centroid, min(CASE WHEN so_far >= 0.85::DOUBLE * total THEN k END) * 16000 / 2048.0 AS roll FROM c GROUP BY ALL),
z AS (SELECT label, part, j, len(list_filter(range(1, 2048), lambda i: (y[i] < 0) <> (y[i + 1] < 0))) / 2048.0 AS zcr FROM fx)"""


@query(f"WITH {JOINED} SELECT label, part, count(*) AS n_frames, round(avg(centroid), 3) AS spectral_centroid, round(avg(CAST(roll AS DOUBLE)), 3) AS spectral_rolloff, round(avg(CAST(zcr AS DOUBLE)), 6) AS zero_crossing_rate FROM f JOIN z USING (label, part, j) GROUP BY ALL")
def spectral_frames(spark: SparkSession, d: str) -> DataFrame:
    """Waves of forty embeddings each, which are several frames long."""
    from clipyard.operators.scans import numbered

    e = numbered(table(spark, d, "embeddings").select("label", "vec_id", "embedding"), ["label"], ["vec_id"], "place")
    own = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]))
    w = e.groupBy("label", F.floor(F.col("place") / 40).alias("part")).agg(own.alias("wave")).withColumn("s", audio.spectral("wave"))
    frames = F.floor(F.size("wave") / audio.HOP) + 1
    return w.select("label", "part", frames.cast("long").alias("n_frames"), F.round("s.spectral_centroid", 3).alias("spectral_centroid"), F.round("s.spectral_rolloff", 3).alias("spectral_rolloff"), F.round("s.zero_crossing_rate", 6).alias("zero_crossing_rate"))


#: One frame, the samples in its middle; magnitudes by the definition of the transform.
SPECTRUM = """b AS (SELECT vec_id, unnest(range(0, 1025)) AS k, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * (0.5 - 0.5 * cos(2 * pi() * (1023 + i) / 2048))) AS e FROM embeddings),
m AS (SELECT vec_id, k, sqrt(pow(list_sum(list_transform(e, lambda x, i: x * cos(2 * pi() * k * (1023 + i) / 2048))), 2) + pow(list_sum(list_transform(e, lambda x, i: x * sin(2 * pi() * k * (1023 + i) / 2048))), 2)) AS s FROM b),
c AS (SELECT *, sum(s) OVER (PARTITION BY vec_id ORDER BY k) AS so_far, sum(s) OVER (PARTITION BY vec_id) AS total FROM m),
f AS (SELECT vec_id, sum(k * s) / sum(s) * 16000 / 2048 AS centroid, min(CASE WHEN so_far >= 0.85::DOUBLE * total THEN k END) * 16000 / 2048.0 AS roll FROM c GROUP BY 1),
z AS (SELECT vec_id, len(list_filter(range(1, len(embedding)), lambda i: (embedding[i] < 0) <> (embedding[i + 1] < 0))) / 2048.0 AS zcr FROM embeddings)"""


@query(f"WITH {SPECTRUM} SELECT vec_id, round(centroid, 3) AS spectral_centroid, round(roll, 3) AS spectral_rolloff, round(CAST(zcr AS DOUBLE), 6) AS zero_crossing_rate FROM f JOIN z USING (vec_id)")
def spectral_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("s", audio.spectral("embedding"))
    return e.select("vec_id", F.round("s.spectral_centroid", 3).alias("spectral_centroid"), F.round("s.spectral_rolloff", 3).alias("spectral_rolloff"), F.round("s.zero_crossing_rate", 6).alias("zero_crossing_rate"))


LOUD = "r AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), l AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda z: z * z)) / len(e)) AS rms, list_max(list_transform(e, lambda z: abs(z))) AS peak FROM r), dn AS (SELECT label, arg_min(e, vec_id) AS d FROM r WHERE vec_id % 6 <> 2 GROUP BY 1)"
NORM = "sqrt(list_sum(list_transform({0}, lambda z: z * z)))"


@query(f"""WITH {SPECTRUM}, {LOUD}, u AS (SELECT vec_id, 'Real' AS type, 'Real' AS method, 1.0::DOUBLE AS speaker_similarity, rms, peak FROM l UNION ALL
SELECT vec_id, 'Fake', ['OpenVoice', 'Seed-VC', 'CosyVoice'][vec_id % 3 + 1], list_sum(list_transform(list_zip(e, d), lambda z: z[1] * z[2])) / ({NORM.format('e')} * {NORM.format('d')}), rms / 2, peak / 2 FROM l LEFT JOIN dn USING (label) WHERE vec_id % 5 > 0)
SELECT vec_id AS clip_id, type, method, round(speaker_similarity, 6) AS speaker_similarity, round(20 * log10(rms + 1e-9), 4) AS rms_db, round(20 * log10((peak + 1e-9) / (rms + 1e-9)), 4) AS crest_factor_db, round(centroid, 3) AS spectral_centroid, round(roll, 3) AS spectral_rolloff, round(CAST(zcr AS DOUBLE), 6) AS zero_crossing_rate
FROM u JOIN f USING (vec_id) JOIN z USING (vec_id)""")  # fmt: skip
def audio_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Real sound, and its fake at half the level where there is one; a donor is a label, its files usable for most tasks."""
    e, k = table(spark, d, "embeddings"), F.col("vec_id")
    donors = sound.first_donors(e.select(F.col("label").alias("donor_video_id"), k.alias("task_order"), F.when(k % 6 != 2, F.col("embedding")).alias("donor")))
    method = S.mapped(F.element_at(F.array(*(F.lit(m) for m in METHOD_NAMES)), (k % 3 + 1).cast("int")), METHOD_NAMES, F.lit("unassigned"))
    fake = e.where("vec_id % 5 > 0").join(donors, e["label"] == donors["donor_video_id"], "left").select(k.alias("clip_id"), method.alias("method"), F.transform("embedding", lambda x: x / 2).alias("wave"), F.col("embedding"), "donor")
    m = sound.metrics(e.select(k.alias("clip_id"), F.col("embedding").cast("array<double>").alias("wave")), fake.withColumn("wave", F.col("wave").cast("array<double>")))
    digits = {"speaker_similarity": 6, "rms_db": 4, "crest_factor_db": 4, "spectral_centroid": 3, "spectral_rolloff": 3, "zero_crossing_rate": 6}
    return m.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("WITH u AS (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings WHERE label % 4 <> 1), m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM u GROUP BY ALL), v AS (SELECT label, sum(m * (pos + 1)) AS s FROM m GROUP BY 1) SELECT l.label, round(s, 4) AS weighted, CASE WHEN s IS NULL THEN 'no valid donor clip' END AS error FROM (SELECT DISTINCT label FROM embeddings) l LEFT JOIN v USING (label)")
def donor_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.when(F.col("label") % 4 != 1, F.col("embedding")).alias("embedding"))
    m = sound.mean_vectors(e, "label", "embedding")
    return m.select("label", F.round(S.sum_of(F.transform("mean", lambda x, i: x * (i + 1))), 4).alias("weighted"), "error")


@query("WITH w AS (SELECT vec_id, embedding AS e, unnest(range(0, 64)) AS i FROM embeddings) SELECT vec_id, CAST(i AS INT) AS i, round(CASE WHEN i < 8 THEN e[i + 1] * pow(cos((7 - i) * pi() / 14), 2) + e[57 + i] * pow(cos(i * pi() / 14), 2) ELSE e[i + 1] END, 6) AS sample FROM w")
def crossfade_samples(spark: SparkSession, d: str) -> DataFrame:
    e = F.transform("embedding", lambda z: z.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(S.crossfade(e, e, 8)).alias("i", "s")).select("vec_id", "i", F.round("s", 6).alias("sample"))


# --- probes, landmarks, videos ------------------------------------------------------------------


def probes(spark: SparkSession, d: str) -> DataFrame:
    """Probe JSON with fields missing in turn."""
    k, none = F.col("event_id"), F.lit(None).cast("string")
    stream = F.struct(
        F.lit(1920).alias("width"), (F.lit(1000) + k % 80).cast("int").alias("height"), F.when(k % 5 == 0, "N/A").when(k % 5 == 1, none).otherwise((k % 900).cast("string")).alias("nb_frames"),
        F.when(k % 4 < 3, (k % 700 / 10).cast("string")).alias("duration"), F.when(k % 3 == 0, "0/0").when(k % 3 == 1, "30000/1001").alias("avg_frame_rate"), F.when(k % 7 < 5, "24/1").when(k % 7 == 5, "0/0").alias("r_frame_rate"),
    )
    whole = F.struct(F.when(k % 8 != 3, "12.5").alias("duration"))
    streams = F.when(k % 13 == 0, F.array().cast("array<struct<width:int,height:int,nb_frames:string,duration:string,avg_frame_rate:string,r_frame_rate:string>>")).otherwise(F.array(stream))
    return table(spark, d, "events").select(k, F.to_json(F.struct(streams.alias("streams"), whole.alias("format"))).alias("json"))


PROBES = "pb AS (SELECT event_id AS k, CASE WHEN event_id % 3 = 1 THEN 30000.0::DOUBLE / 1001 WHEN event_id % 7 < 5 THEN 24.0::DOUBLE ELSE 25.0 END AS fps, CASE WHEN event_id % 4 < 3 THEN (event_id % 700) / 10.0::DOUBLE WHEN event_id % 8 <> 3 THEN 12.5 ELSE 0 END AS duration FROM events WHERE event_id % 13 > 0)"


@query(f"WITH {PROBES} SELECT k AS event_id, round(duration, 4) AS duration, CASE WHEN k % 5 > 1 THEN k % 900 ELSE CAST(round_even(duration * fps, 0) AS BIGINT) END AS frame_count, 1920 AS width, CAST(1000 + k % 80 AS INT) AS height, round(fps, 6) AS fps FROM pb")
def probe_facts(spark: SparkSession, d: str) -> DataFrame:
    p = probes(spark, d).withColumn("p", S.probe(F.col("json"))).where("p IS NOT NULL")
    return p.select("event_id", F.round("p.duration", 4).alias("duration"), "p.frame_count", "p.width", "p.height", F.round("p.fps", 6).alias("fps"))


@query(f"WITH {PROBES} SELECT k AS event_id FROM pb WHERE duration >= 5")
def long_videos(spark: SparkSession, d: str) -> DataFrame:
    return clips.long_enough(probes(spark, d).select("event_id", S.probe(F.col("json"))["duration"].alias("duration")), 5.0).select("event_id")


@query("SELECT event_id, CASE WHEN event_id % 7 > 0 THEN round((event_id % 17) / greatest(event_id % 23, 1e-6::DOUBLE), 6) END AS opening FROM events")
def mouth_opening(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    x = lambda i: F.when(i == 308, k % 23).otherwise(F.lit(0)).cast("double")
    y = lambda i: F.when(i == 13, k % 17).otherwise(F.lit(0)).cast("double")
    points = F.when(k % 7 > 0, F.transform(F.sequence(F.lit(0), F.lit(308)), lambda i: F.struct(x(i).alias("x"), y(i).alias("y"))))
    return table(spark, d, "events").select("event_id", F.round(S.mouth_opening(points), 6).alias("opening"))


# --- files --------------------------------------------------------------------------------------


@query("""SELECT n_name AS speakers, c_custkey AS k, CASE c_nationkey % 3 WHEN 0 THEN 'rep_moldova' WHEN 1 THEN 'moldova' ELSE ['banat', 'oltenia', ''][c_custkey % 3 + 1] END AS dialect, CASE WHEN c_nationkey % 3 = 0 THEN 'f' END AS gender,
CASE WHEN c_nationkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'news' ELSE '' END WHEN c_nationkey % 3 = 1 THEN 'unknown' ELSE 'talk' END AS category, row_number() OVER (PARTITION BY c_nationkey % 3 ORDER BY c_custkey) - 1 AS place FROM customer JOIN nation ON n_nationkey = c_nationkey""")  # fmt: skip
def read_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Three catalogues written as CSV and read as one: with blank categories; an older one without two columns; one with a dialect of its own in each row."""
    from pyspark.sql import Window

    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    kind, k = F.col("c_nationkey") % 3, F.col("c_custkey")
    own = F.element_at(F.array(F.lit("banat"), F.lit("oltenia"), F.lit("")), (k % 3 + 1).cast("int"))
    c = c.select(kind.alias("kind"), k.alias("Link"), F.col("n_name").alias("Speakers"), F.when(kind == 2, "talk").when(k % 2 == 0, "news").otherwise("").alias("Category"), F.lit("f").alias("Gender"), own.alias("Dialect"))
    base = f"{tables.shared_dir(spark).rstrip('/')}/catalogue-{q.unique()}"
    for i, columns in enumerate((["Link", "Speakers", "Category", "Gender"], ["Link", "Speakers"], ["Link", "Speakers", "Category", "Dialect"])):
        c.where(F.col("kind") == i).orderBy("Link").select(*columns).coalesce(1).write.option("header", True).csv(f"{base}/{i}")
    out = tables.catalogue(spark, {f"{base}/{i}": x for i, x in enumerate(("rep_moldova", "moldova", "other"))})
    place = F.row_number().over(Window.partitionBy("file_order").orderBy("row_order")) - 1
    return out.select(F.col("Speakers").alias("speakers"), F.col("Link").cast("long").alias("k"), "dialect", F.col("Gender").alias("gender"), F.coalesce("Category", F.lit("unknown")).alias("category"), place.cast("long").alias("place"))


@query("SELECT CAST(c_nationkey AS INT) AS folder, 1::BIGINT AS n_files, sum(strlen(c_name) + 1)::BIGINT AS bytes FROM customer GROUP BY 1")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """A folder per nation, and what a listing by suffix finds there."""
    base = f"{tables.shared_dir(spark).rstrip('/')}/files-{q.unique()}"
    table(spark, d, "customer").select("c_name", F.col("c_nationkey").alias("k")).repartition("k").write.partitionBy("k").text(base)
    found = tables.inventory(spark, base, (".txt",)).select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("int").alias("folder"), "length")
    return found.groupBy("folder").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


def manifests(spark: SparkSession, d: str) -> DataFrame:
    """Keyed JSON manifests of fifty entries each, fields missing in turn."""
    m, k = q.clip_rows(spark, d).where("dialect IS NOT NULL AND video_id IS NOT NULL"), F.col("doc_id")
    some = lambda n: F.when(k % n > 0, F.transform(F.sequence(F.lit(1), (k % n).cast("int")), lambda i: F.concat(F.lit("d"), i.cast("string"))))
    manipulation = F.struct(F.when(k % 4 > 0, F.element_at(F.array(*(F.lit(x) for x in METHOD_NAMES)), (k % 3 + 1).cast("int"))).alias("assigned_method"), some(3).alias("donor_audio_paths"), some(5).alias("donor_clips"))
    names = [*labels.SPLITS, "odd_one"]
    split = F.struct(F.when(k % 6 > 0, "train").alias("protocol_1_ood"), F.element_at(F.array(*(F.lit(x) for x in names)), (k % len(names) + 1).cast("int")).alias("protocol_2_fewshot"))
    entry = F.struct(F.col("key"), F.when(k % 9 > 0, F.concat(F.lit("maramures_itw_"), k.cast("string"))).alias("video_id"), F.when(k % 2 == 0, F.col("dialect")).alias("dialect"), F.when(k % 5 > 0, F.col("environment")).alias("environment"), split.alias("splits"), manipulation.alias("audio_manipulation"))
    return m.groupBy(F.floor(k / 50).alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("c"), k.cast("string")), entry)))).alias("value"))


@query("SELECT 'c' || doc_id AS entry_key, lang || '_' || source || '__' || doc_id AS key, CAST(greatest(doc_id % 3, 0) AS INT) AS n_paths FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND doc_id IS NOT NULL")
def read_manifest(spark: SparkSession, d: str) -> DataFrame:
    return tables.manifest(manifests(spark, d)).select("entry_key", "key", F.size(F.coalesce("audio_manipulation.donor_audio_paths", F.array().cast("array<string>"))).alias("n_paths"))


@query("SELECT 'c' || doc_id AS entry_key, lang || '_' || source || '__' || doc_id || ' }, \"' AS key, CAST(greatest(doc_id % 3, 0) AS INT) AS n_paths FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND doc_id IS NOT NULL")
def read_large_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Manifests as files of large objects, with braces and quotes in their strings; no file is read as a whole."""
    m = q.clip_rows(spark, d).where("dialect IS NOT NULL AND video_id IS NOT NULL")
    k = F.col("doc_id")
    paths = F.transform(F.when(k % 3 > 0, F.sequence(F.lit(1), (k % 3).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit('\\{"'), i.cast("string"), F.lit("\\")))
    entry = F.struct(F.concat("key", F.lit(' }, "')).alias("key"), F.struct(F.lit("x").alias("protocol_1_ood")).alias("splits"), F.struct(paths.alias("donor_audio_paths")).alias("audio_manipulation"))
    text = F.concat(F.lit('"c'), k.cast("string"), F.lit('": '), F.to_json(entry))
    whole = m.groupBy(F.floor(k / 400).alias("file")).agg(F.concat(F.lit("{\n"), F.array_join(F.collect_list(text), ",\n  "), F.lit("\n}")).alias("value"))
    path = _folder(spark, "manifests")
    whole.select("value").write.option("lineSep", "\n\n").text(path)
    got = tables.large_manifest(spark, path, 100)
    return got.select("entry_key", "key", F.size("audio_manipulation.donor_audio_paths").alias("n_paths"))


@query("""SELECT 'c' || doc_id AS clip_id, CASE WHEN doc_id % 9 > 0 THEN 'maramures_itw_' || doc_id ELSE 'unknown' END AS video_id, CASE WHEN doc_id % 2 = 0 THEN lang WHEN doc_id % 9 > 0 THEN 'Maramureș' ELSE 'C' || doc_id END AS dialect,
CASE WHEN doc_id % 5 > 0 THEN CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 2 = 0 THEN 'In-the-Wild' ELSE 'Studio' END WHEN doc_id % 9 > 0 THEN 'In-the-Wild' ELSE 'Studio' END AS environment, CASE WHEN doc_id % 6 > 0 THEN 'Train' ELSE 'unknown' END AS protocol_1_ood, ['Train', 'Validation', 'Test (In-Domain)', 'Test OOD (Maramureș)', 'Test OOD (Rep. Moldova)', 'odd_one'][doc_id % 6 + 1] AS protocol_2_fewshot,
CASE WHEN doc_id % 4 > 0 THEN ['OpenVoice', 'Seed-VC', 'CosyVoice'][doc_id % 3 + 1] ELSE 'unassigned' END AS audio_method, CAST(CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 ELSE doc_id % 5 END AS INT) AS num_donors FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND doc_id IS NOT NULL""")  # fmt: skip
def manifest_frame(spark: SparkSession, d: str) -> DataFrame:
    return metadata.manifest_frame(tables.manifest(manifests(spark, d)))


@query(f"WITH {q.CLIPS}, p AS (SELECT 'nested' AS layout, dialect || '/' || doc_id % 100 || '.wav' AS dest FROM cl UNION ALL SELECT 'flat', doc_id % 100 || '.wav' FROM cl), c AS (SELECT layout, dest, count(*) AS n FROM p WHERE dest IS NOT NULL GROUP BY ALL) SELECT layout, dest, n FROM c WHERE n > 1")
def audio_layouts(spark: SparkSession, d: str) -> DataFrame:
    c, stem = q.clip_rows(spark, d), (F.col("doc_id") % 100).cast("string")
    of = lambda name: metadata.collisions(c.select(metadata.audio_destination(F.col("dialect"), stem, name == "nested").alias("dest")).where("dest IS NOT NULL")).select(F.lit(name).alias("layout"), "dest", "n")
    return of("nested").unionByName(of("flat"))


@query(f"WITH {q.FAKED}, fl AS (SELECT audio_path AS path FROM cl WHERE doc_id % 3 <> 1 AND doc_id % 10 <> 0) SELECT type, count(*) AS n, count(*) FILTER (path NOT IN (SELECT path FROM fl)) AS n_missing FROM sm GROUP BY 1")
def missing_samples(spark: SparkSession, d: str) -> DataFrame:
    return metadata.missing(metadata.samples(q.faked(spark, d)), q.files(spark, d))


# --- statistics ---------------------------------------------------------------------------------


@query(f"WITH {q.SPLITS} SELECT dialect, " + ", ".join(f"count(*) FILTER (p1 = '{c}') AS {c}" for c in ("train", "val", "test_id", "test_ood_de", "test_ood_es")) + ", count(*) AS total FROM sl WHERE p1 IN ('train', 'val', 'test_id', 'test_ood_de', 'test_ood_es') GROUP BY 1")
def split_crosstab_ood(spark: SparkSession, d: str) -> DataFrame:
    return stats.crosstab(q.split_rows(spark, d), "dialect", "p1", ["train", "val", "test_id", "test_ood_de", "test_ood_es"])


CELLS = [f"{lang}_{env}" for lang in ("de", "en", "es", "fr") for env in ("itw", "studio")]


@query(f"WITH {q.METHODS_SQL} SELECT assigned_method, " + ", ".join(f"count(*) FILTER (dialect || '_' || environment = '{c}') AS {c}" for c in CELLS) + " FROM me GROUP BY 1")
def method_env_wide(spark: SparkSession, d: str) -> DataFrame:
    return stats.wide(q.method_rows(spark, d), "assigned_method", F.concat_ws("_", "dialect", "environment"), CELLS)


@query("""WITH t AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'Rep. Moldova' ELSE 'Oltenia' END AS dialect,
 unnest(CASE doc_id % 6 WHEN 0 THEN ['Moldova'] WHEN 1 THEN ['Oltenia'] WHEN 2 THEN ['Maramureș', 'Clip_2'] WHEN 3 THEN ['Oltenia', ''] WHEN 4 THEN ['Moldova'] ELSE ['Somewhere'] END) AS donor_dialect FROM documents)
SELECT dialect, donor_dialect, count(*) AS n FROM t GROUP BY ALL""")
def donor_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Donors by field (a label, or text that holds one), by video, and by the folders of their clips under both names."""
    k, none = (F.col("doc_id") % 6).cast("int"), F.lit(None).cast("array<string>")
    paths = lambda *p: F.array(*(F.lit(x) for x in p))
    t = table(spark, d, "documents").select(
        F.when(F.col("doc_id") % 4 == 0, "REP_MOLDOVA").when(F.col("doc_id") % 4 == 1, "").alias("dialect"), F.when(F.col("doc_id") % 2 == 0, "rep_moldova_itw_1").otherwise("oltenia_2").alias("video_id"),
        F.when(k == 0, "moldova").when(k == 4, "moldova_north").when(k == 5, "SOMEWHERE").alias("donor_dialect"), F.when(k == 1, "oltenia_studio_x").otherwise("").alias("donor_video_id"),
        F.when(k == 2, paths("audio/muntenia/maramures_itw_1/a.wav", "x/clip_2/b.wav")).alias("donor_audio_paths"), F.when(k == 3, paths("/data/moldova/oltenia_studio_q/b.wav", "c.wav")).otherwise(none).alias("donor_clips"),
    )
    return stats.transfer(t)


@query(f"WITH {q.METHODS_SQL}, c AS (SELECT assigned_method, count(*) AS n FROM me GROUP BY 1) SELECT 'known' AS kind, assigned_method, n, CAST(row_number() OVER (ORDER BY CASE assigned_method WHEN 'cosyvoice' THEN 1 ELSE 2 END) AS INT) AS place FROM c WHERE assigned_method IN ('cosyvoice', 'seed_vc') UNION ALL SELECT 'fallback', l_returnflag, n, CAST(row_number() OVER (ORDER BY n DESC, l_returnflag) AS INT) FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)")
def method_order(spark: SparkSession, d: str) -> DataFrame:
    known = stats.in_order(q.method_rows(spark, d), "assigned_method", ["cosyvoice", "other", "seed_vc"])
    rest = stats.in_order(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "assigned_method"), "assigned_method", ["other"])
    return known.withColumn("kind", F.lit("known")).unionByName(rest.withColumn("kind", F.lit("fallback")))


@query("SELECT event_id, user_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS n_errors FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 10")
def job_errors(spark: SparkSession, d: str) -> DataFrame:
    return stats.first_errors(table(spark, d, "events").select("event_id", "user_id", "event_type"), F.col("event_type") == "error", "event_id").select("event_id", "user_id", "n_errors")


@query(f"WITH {q.FAKED}, fl AS (SELECT audio_path AS path FROM cl WHERE doc_id % 3 <> 1 AND doc_id % 10 <> 0) SELECT (SELECT count(*) FROM fk) AS manifest_keys, count(*) FILTER (type = 'real' AND path IN (SELECT path FROM fl)) AS real_rows, count(*) FILTER (type = 'fake' AND path IN (SELECT path FROM fl)) AS fake_rows, count(*) FILTER (path IN (SELECT path FROM fl)) AS total, count(*) FILTER (path NOT IN (SELECT path FROM fl)) AS missing FROM sm")
def build_audit(spark: SparkSession, d: str) -> DataFrame:
    """What a build keeps: samples whose file is there, and how many are missing."""
    f = q.faked(spark, d)
    by = metadata.missing(metadata.samples(f), q.files(spark, d))
    kept = F.col("n") - F.col("n_missing")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("type") == kind, kept)), F.lit(0)).alias(f"{kind}_rows")
    sums = by.agg(of("real"), of("fake"), F.coalesce(F.sum(kept), F.lit(0)).alias("total"), F.coalesce(F.sum("n_missing"), F.lit(0)).alias("missing"))
    return sums.join(F.broadcast(f.agg(F.count("*").alias("manifest_keys"))))


# --- files of results ---------------------------------------------------------------------------


@query(f"""WITH {q.TOP}, bx AS (SELECT t.video_id, t.a, quantile_cont(x1, 0.5) AS x1, quantile_cont(y1, 0.5) AS y1, quantile_cont(x2, 0.5) AS x2, quantile_cont(y2, 0.5) AS y2 FROM top t JOIN det d ON d.video_id = t.video_id AND d.time_sec >= t.a AND d.time_sec < t.b GROUP BY ALL)
SELECT top.video_id || '/' || printf('%03d_%010.3f.mp4', ordinal, {q.rounded('top.a', 3)}) AS clip_filename, top.video_id AS source_video, {q.rounded('b - top.a', 3)} AS duration_sec, track_id, {q.rounded('top.a', 3)} AS start_sec, {q.rounded('b', 3)} AS end_sec, {q.rounded('presence', 4)} AS presence_ratio, {q.rounded('speech', 4)} AS speech_ratio,
{q.rounded('talking', 4)} AS talking_ratio, {q.rounded('face', 4)} AS face_height_ratio, {q.rounded('mean_confidence', 4)} AS mean_confidence, '[' || concat_ws(', ', {q.rounded('x1', 1)}, {q.rounded('y1', 1)}, {q.rounded('x2', 1)}, {q.rounded('y2', 1)}) || ']' AS median_bbox FROM top JOIN bx ON bx.video_id = top.video_id AND bx.a = top.a""")  # fmt: skip
def clip_metadata_file(spark: SparkSession, d: str) -> DataFrame:
    """The metadata file of the ranked clips, written and read again."""
    _, w = q._quality(spark, d)
    path = _folder(spark, "clips")
    sinks.write_csv(sinks.clip_records(clips.top(w, q.RULES)), path, sinks.CLIPS)
    return sinks.read_csv(spark, path, sinks.CLIPS)


@query(f"""WITH {q.TOP} SELECT t.video_id, printf('%03d_%010.3f.mp4', ordinal, {q.rounded('t.a', 3)}) AS clip_filename, t.track_id AS speaker_track_id, {q.rounded('t.a', 3)} AS start_sec, d.frame, {q.rounded(f"d.time_sec - {q.rounded('t.a', 3)}", 3)} AS time_sec, {q.rounded('d.time_sec', 3)} AS source_time_sec, {q.rounded('d.x2', 1)} AS x2, {q.rounded('d.confidence', 4)} AS confidence, d.is_talking
FROM top t JOIN det d ON d.video_id = t.video_id AND {q.rounded('t.a', 3)} <= d.time_sec AND d.time_sec < t.b""")  # fmt: skip
def annotation_files(spark: SparkSession, d: str) -> DataFrame:
    """A file of annotations for each video, written and read again."""
    det, w = q._quality(spark, d)
    path = _folder(spark, "annotations")
    sinks.write_by_video(sinks.annotation_records(clips.annotations(clips.top(w, q.RULES), det, q.RULES)), path)
    a = sinks.read_by_video(spark, path, sinks.ANNOTATIONS)
    return a.select("video_id", "clip_filename", "speaker_track_id", "start_sec", F.explode("boxes").alias("b")).select("video_id", "clip_filename", "speaker_track_id", "start_sec", "b.frame", "b.time_sec", "b.source_time_sec", F.col("b.bbox_xyxy")[2].alias("x2"), "b.confidence", "b.is_talking")


@query(f"WITH {q.DET} SELECT video_id, dense_rank() OVER (PARTITION BY video_id ORDER BY frame) - 1 AS sample_idx, frame, CAST(floor(round(time_sec, 4)) AS BIGINT) AS second, round(x1, 2) AS x1, round(y2, 2) AS y2, round(confidence, 5) AS confidence FROM det")
def timeline_files(spark: SparkSession, d: str) -> DataFrame:
    """A timeline for each video, written as files that the reader of timelines finds, and read again."""
    det = q.detections(spark, d).withColumns({"sample_idx": F.col("frame"), "box_idx": F.lit(0)})
    path = _folder(spark, "timelines")
    sinks.write_by_video(tables.nested(det).withColumn("source_video", F.col("video_id")), path)
    t = spark.read.schema(tables.DETECTIONS).option("recursiveFileLookup", True).json(path)
    return tables.flattened(t, 0.0).select("video_id", F.col("sample_idx").cast("long").alias("sample_idx"), "frame", F.floor("time_sec").alias("second"), "x1", "y2", "confidence")


@query(SQL["audio_metrics"].replace("vec_id AS clip_id", "CAST(vec_id AS VARCHAR) AS clip_id"))
def metrics_file(spark: SparkSession, d: str) -> DataFrame:
    """The file of sound metrics, written and read again."""
    path = _folder(spark, "metrics")
    sinks.write_csv(audio_metrics(spark, d), path, sinks.METRICS)
    return sinks.read_csv(spark, path, sinks.METRICS)


@query("SELECT user_id, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1")
def published_table(spark: SparkSession, d: str) -> DataFrame:
    """A table published three times, the last time from the version before; readers take the newest."""
    path = _folder(spark, "published")
    e = table(spark, d, "events")
    tables.publish(e.select("user_id").limit(0), path)
    tables.publish(e.groupBy("user_id").agg(F.count("*").alias("n")), path)
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first_event"))
    tables.publish(tables.published(spark, path).join(first, "user_id"), path)
    return tables.published(spark, path)


@query("SELECT user_id AS k, min(CASE WHEN event_id % 3 < 2 THEN event_id END) AS v FROM events WHERE event_id % 3 < 2 GROUP BY 1 UNION ALL SELECT user_id, min(event_id) FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 3 < 2) GROUP BY 1")
def picked_up_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that arrive in two turns; the rows of a key are taken once, from the first turn that has it, and a third run finds nothing new."""
    from clipyard.streaming import incremental

    base = _folder(spark, "arrivals")
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"))
    for turn in (F.col("v") % 3 < 2, F.col("v") % 3 == 2, F.lit(False)):
        e.where(turn).write.mode("append").json(f"{base}/in")
        incremental.pick_up(spark, f"{base}/in", "k long, v long", f"{base}/out", f"{base}/seen", lambda b: b, "k")
    return spark.read.parquet(f"{base}/out").select("k", "v")
