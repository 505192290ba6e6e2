"""Column functions: times, links, boxes, labels and sample arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits, halves away from zero. It is first rounded to 8 digits, so that what sums and differences of doubles are off beyond these decides no tie."""
    return F.round(F.round(x, 8), digits)


def seconds(ts: Column) -> Column:
    """'H:MM:SS' with any number of parts to seconds; null where empty or malformed."""
    parts = F.split(F.trim(ts), ":")
    return F.when(F.trim(ts) != "", F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x.try_cast("double")))


def trim_bounds(trim: Column) -> Column:
    """'a-b' to struct(start, end, ok): empty is whole (nulls, ok), anything but two valid times is not ok."""
    text = F.coalesce(F.trim(trim), F.lit(""))
    parts = F.split(text, "-")
    start, end = seconds(F.get(parts, 0)), seconds(F.get(parts, 1))
    two = (F.size(parts) == 2) & start.isNotNull() & end.isNotNull()
    return F.struct(F.when(two, start).alias("start"), F.when(two, end).alias("end"), ((text == "") | two).alias("ok"))


def video_id(url: Column) -> Column:
    """Id of a link of the two known forms; 'unknown_id' for others, null for a watch link without one."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PATH"))
    watch = host.isin("www.youtube.com", "youtube.com") & (path == "/watch")
    return F.when(host == "youtu.be", F.substring(path, 2, 1 << 20)).when(watch, F.try_parse_url(url, F.lit("QUERY"), F.lit("v"))).otherwise("unknown_id")


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2); negative sides count as 0, an empty union as 0."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo)
    inter = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    union = side(a[0], a[2]) * side(a[1], a[3]) + side(b[0], b[2]) * side(b[1], b[3]) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def clamp(x: Column, most: Column) -> Column:
    return F.least(F.greatest(F.bround(x), F.lit(0.0)), most)


def mouth_opening(points: Column) -> Column:
    """|y13 - y14| / max(|x78 - x308|, 1e-6) of landmarks (x, y); null without landmarks."""
    at = lambda i: F.element_at(points, i + 1)
    return F.when(F.size(points) > 308, F.abs(at(13)["y"] - at(14)["y"]) / F.greatest(F.abs(at(78)["x"] - at(308)["x"]), F.lit(1e-6)))


def rate(fraction: Column) -> Column:
    """'30000/1001' to frames per second; 0 where the denominator is 0."""
    parts = F.split(fraction, "/")
    n, d = F.get(parts, 0).try_cast("double"), F.coalesce(F.get(parts, 1).try_cast("double"), F.lit(1.0))
    return F.when(d == 0, 0.0).otherwise(n / d)


PROBE = "streams array<struct<width:int,height:int,nb_frames:string,duration:string,avg_frame_rate:string,r_frame_rate:string>>, format struct<duration:string>"


def probe(text: Column) -> Column:
    """struct(duration, frame_count, width, height, fps) of a probe's JSON; null without a video stream. The average rate counts where it is over 0, then the nominal one, then 25; the stream's duration, then the file's, then 0; frames are computed where they are not given."""
    p = F.from_json(text, PROBE)
    s = F.get(p["streams"], 0)
    known = lambda x: F.nullif(x, F.lit(""))
    average = F.coalesce(rate(s["avg_frame_rate"]), F.lit(0.0))
    nominal = F.coalesce(F.nullif(rate(s["r_frame_rate"]), F.lit(0.0)), F.lit(25.0))
    fps = F.when(average > 0, average).otherwise(nominal)
    duration = F.coalesce(known(s["duration"]), known(p["format"]["duration"]), F.lit("0")).cast("double")
    given = F.when(s["nb_frames"] != "N/A", known(s["nb_frames"])).cast("long")
    return F.when(s.isNotNull(), F.struct(duration.alias("duration"), F.coalesce(given, F.bround(duration * fps).cast("long")).alias("frame_count"), s["width"].alias("width"), s["height"].alias("height"), fps.alias("fps")))


def capitalised(x: Column) -> Column:
    return F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1 << 20)))


def mapped(x: Column, names: dict[str, str], otherwise: Column) -> Column:
    """Name of a label whatever its case, or `otherwise`."""
    table = F.create_map(*(F.lit(v) for kv in names.items() for v in kv))
    return F.coalesce(F.try_element_at(table, F.lower(x)), otherwise)


def first_containing(x: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    """Name of the first rule whose key the text contains."""
    out = None
    for key, name in rules:
        hit = F.contains(F.lower(x), F.lit(key))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return otherwise if out is None else out.otherwise(otherwise)


def sum_of(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return sum_of(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero, null where either is."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def rms(wave: Column) -> Column:
    return F.when(F.size(wave) > 0, F.sqrt(dot(wave, wave) / F.size(wave)))


def loudness_db(wave: Column) -> Column:
    return 20 * F.log10(rms(wave) + 1e-9)


def crest_db(wave: Column) -> Column:
    peak = F.array_max(F.transform(wave, lambda x: F.abs(x.cast("double"))))
    return 20 * F.log10((peak + 1e-9) / (rms(wave) + 1e-9))


def crossfade(first: Column, second: Column, overlap: int) -> Column:
    """second with its first `overlap` samples faded in over the last of first, cosine-squared; of a shorter second only what it has."""
    quarter = 3.141592653589793 / 2
    step = quarter / max(1, overlap - 1)
    fade = lambda i: F.pow(F.cos(i.cast("double") * step), F.lit(2.0))
    rise = lambda i: F.pow(F.cos(quarter - i.cast("double") * step), F.lit(2.0))
    tail = F.slice(first, F.greatest(F.size(first) - overlap + 1, F.lit(1)), overlap)
    return F.transform(second, lambda x, i: F.when(i < overlap, x * rise(i) + F.get(tail, i) * fade(i)).otherwise(x))


def relative(path: Column, root: str) -> Column:
    """Path from root: what follows it, or with '..' for each level to climb."""
    base = root.rstrip("/")
    parts, up = F.split(path, "/"), F.array(*(F.lit(p) for p in base.split("/")))
    same = F.aggregate(F.zip_with(F.slice(parts, 1, F.least(F.size(parts), F.size(up))), F.slice(up, 1, F.least(F.size(parts), F.size(up))), lambda a, b: a == b), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, eq: F.struct((s["n"] + (s["on"] & eq).cast("int")).alias("n"), (s["on"] & eq).alias("on")))["n"]
    outside = F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(up) - same), F.slice(parts, same + 1, F.size(parts))), "/")
    return F.when(F.startswith(path, F.lit(base + "/")), F.substring(path, len(base) + 2, 1 << 20)).otherwise(outside)
