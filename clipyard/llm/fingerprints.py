"""Operator 8. Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

Terms are pairs of neighbouring words (the last word also alone), weighted 1 + ln(count). The samples are Ioffe's:
from hashes of the term come r, c ~ Gamma(2, 1) and b ~ U(0, 1); with weight w, t = floor(ln w / r + b) and
ln a = ln c - r (t - b) - r, and the term of least a is drawn, as (term, t). Each term takes part in one of `bins`
bins, chosen by its hash, so that a text costs one sample per term and not `bins` of them; a bin's draw falls together
in two texts with the generalised Jaccard similarity of what they hold in it. The likeness is the share of equal draws
among the bins that either text fills.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipyard.llm.common import partitions, table

BINS = 64
_UNIT = float(1 << 32)
_EMPTY = "...."


def tokens(text: Column) -> Column:
    """Hashes of the terms of a text, repeated as they repeat; an empty text has the one term of the empty word."""
    words = F.split(F.btrim(F.lower(text)), r"\s+")
    return F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))


def _draw(term: Column, weight: Column) -> Column:
    """The term's sample as one long: ln a in the high bits, 16 bits of (term, t) in the low ones, so that min() draws."""
    one, two = F.xxhash64(term, F.lit(1)), F.xxhash64(term, F.lit(2))
    unit = lambda h, shift: (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 32) - 1)) + 0.5) / _UNIT
    gamma = lambda h: -F.ln(unit(h, 0) * unit(h, 32))
    r, c = gamma(one), gamma(two)
    b = F.pmod(F.xxhash64(term, F.lit(3)), F.lit(1 << 24)) / float(1 << 24)
    t = F.floor(F.ln(weight) / r + b)
    ln_a = F.ln(c) - r * (t - b) - r
    mark = F.xxhash64(term, t).bitwiseAND(F.lit(0xFFFF))
    scaled = F.least(F.greatest(ln_a, F.lit(-250.0)), F.lit(250.0)) + 256.0
    return F.shiftleft((scaled * float(1 << 37)).cast("long"), 16).bitwiseOR(mark)


def draws(terms: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """keys and `fingerprint` from rows of keys and `term`: four hex digits for each bin, or dots where it is empty."""
    weighted = terms.groupBy(*keys, "term").agg(F.count("*").alias("n"))
    sample = weighted.select(*keys, F.pmod(F.xxhash64("term", F.lit(4)), F.lit(bins)).cast("int").alias("bin"), _draw(F.col("term"), 1 + F.ln(F.col("n").cast("double"))).alias("draw"))
    least = sample.groupBy(*keys, "bin").agg(F.min("draw").alias("draw"))
    held = least.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.lower(F.lpad(F.hex(F.col("draw").bitwiseAND(F.lit(0xFFFF))), 4, "0"))))).alias("m"))
    return held.select(*keys, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(_EMPTY))), "").alias("fingerprint"))


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Share of equal bins among those that are filled in either fingerprint; 1 for two texts that fill none."""
    at = F.sequence(F.lit(0), F.lit(bins - 1))
    cut = lambda x, i: F.substring(x, i * 4 + 1, F.lit(4))
    filled = F.size(F.filter(at, lambda i: (cut(a, i) != _EMPTY) | (cut(b, i) != _EMPTY)))
    same = F.size(F.filter(at, lambda i: (cut(a, i) == cut(b, i)) & (cut(a, i) != _EMPTY)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(same / filled)


def fingerprint(docs: DataFrame, bins: int = BINS) -> DataFrame:
    """doc_id and fingerprint of each distinct (doc_id, text); a null text is empty."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("k_text"), F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term"))
    return draws(keyed, ["doc_id", "k_text"], bins).drop("k_text")


def _below(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are less than x; null for null. Looked up in two steps, so that a row meets about twice the root of their number."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    held = lambda own: F.split(F.lit(",".join(map(str, own))), ",").cast("array<bigint>")  # noqa: E731  one literal, however many
    less = lambda own: F.size(F.filter(own, lambda c: c < x))
    coarse = step * less(held(cuts[step - 1 :: step])) if len(cuts) >= step else F.lit(0)
    return F.when(x.isNotNull(), coarse + less(F.slice(held(cuts), coarse + 1, F.lit(step))))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, rn, doc_id, text, next: each row with the text of the row after it by descending doc_id (null last; ties by text), the first row's after the last.

    doc_id is cut into ranges of about equal rows. Each range also gets the first row of the range after it (`extra`),
    so that neighbours meet in one window of one range, and no window spans the table.
    """
    found = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], max(10000, 20 * buckets))).first()[0] if buckets > 1 else None
    cuts = sorted(set(found or []))
    # Bucket 0 holds the largest ids; null ids come last, with the smallest.
    place = F.lit(len(cuts)) - F.coalesce(_below(F.col("doc_id"), cuts), F.lit(0))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), place.cast("int").alias("bucket"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), -F.col("doc_id"), F.col("text"))
    first = own.groupBy("bucket").agg(F.min_by(F.struct("doc_id", "text"), order).alias("row"))
    # Ranges without rows don't occur; the window runs over the numbers of ranges alone (at most `buckets`), not over texts.
    w = Window.orderBy("bucket")
    before = own.select("bucket").distinct().select("bucket", F.coalesce(F.lag("bucket").over(w), F.max("bucket").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    extra = first.join(F.broadcast(before), "bucket").select("row.doc_id", "row.text", F.col("before").alias("bucket"))
    both = own.withColumn("extra", F.lit(False)).unionByName(extra.withColumn("extra", F.lit(True)))
    w = Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").desc_nulls_last(), "text")
    return both.repartitionById(buckets, F.col("bucket")).select("bucket", "extra", "doc_id", "text", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("next"))


def compare_edited(docs: DataFrame, bins: int = BINS, buckets: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty; a table of one row is its own next document; an empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * partitions(spark)
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    rows = with_next(docs, buckets).withColumn("edited", F.when(~F.col("extra"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))))
    versions = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("x")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("x")))
    each = rows.select("bucket", "rn", F.explode(F.filter(versions, lambda s: s["x"].isNotNull())).alias("s")).select("bucket", "rn", F.col("s.v").alias("v"), F.explode(tokens(F.col("s.x"))).alias("term"))
    prints = draws(each, ["bucket", "rn", "v"], bins)
    prints = prints.groupBy("bucket", "rn").agg(F.max(F.when(F.col("v") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("v") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    prints = prints.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("rn")))
    about = rows.where(~F.col("extra")).select("bucket", "rn", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    out = about.join(prints, ["bucket", "rn"])
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), bins).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint"), bins).alias("near_next"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
