"""Operator 3. Language of a text: the nearest of several TF-IDF centroids per language, by cosine.

Features are counts of character n-grams (n = 1, 2, 3 over lower-cased text, runs of non-letters as one space) in
hashed buckets, log-damped, times IDF, normalised. Each language gets up to `per_language` centroids by bisecting
spherical k-means, so that prose, upper-case noise or short lines of one language need not share one mean. A text whose best
cosine is below its centroid's radius (`margin` times the cosine that all but LOW of the centroid's training rows reach) is rejected.

The classifier is fitted on a bounded sample of labelled rows (`sample_rows`, chosen by hash of doc_id, whole texts);
prediction covers every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipyard.llm.common import mix, table, tidy, trim

BUCKETS, PER_LANGUAGE, SAMPLE_ROWS, LEAST_ROWS, LEAST_SHARE, LOW, MARGIN = 4096, 4, 3000, 15, 0.05, 0.01, 0.5
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")
_PIECE = 1 << 20
_ONES = (1 << 16) - 1
#: For code points below 2**16: the lower-cased letter, or 32.
_FOLD = None


def _fold() -> np.ndarray:
    global _FOLD
    if _FOLD is None:
        table_ = np.full(_ONES + 1, 32, np.uint32)
        for cp in range(_ONES + 1):
            ch = chr(cp)
            if ch.isalpha():
                low = ch.lower()
                table_[cp] = ord(low) if len(low) == 1 else cp
        _FOLD = table_
    return _FOLD


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(ch.isalpha() for ch in text))


def counts(text: str, buckets: int) -> np.ndarray:
    """Hashed n-gram counts of a whole text, in pieces that overlap by two code points."""
    fold, out = _fold(), np.zeros(buckets, np.float32)
    for at in range(0, len(text), _PIECE):
        cp = np.frombuffer(text[max(0, at - 2) : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = np.where(cp <= _ONES, fold[np.minimum(cp, _ONES)], cp)
        keep = np.ones(len(cp), bool)
        keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
        cp = np.concatenate([[32], cp[keep], [32]]).astype(np.uint64)
        two = cp[:-1] << np.uint64(21) | cp[1:]
        three = two[:-1] << np.uint64(21) | cp[2:]
        for grams in (cp, two, three):
            out += np.bincount((mix(grams) >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets)
    return out


@dataclass(frozen=True)
class Model:
    idf: np.ndarray  # buckets
    centroids: np.ndarray  # n x buckets, unit rows
    labels: tuple[str, ...]  # of each centroid
    radius: np.ndarray  # least cosine of each centroid

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = np.log1p(rows) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return x @ self.centroids.T


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Bisecting spherical k-means; rows of x are unit vectors. The cluster whose rows are farthest from its centroid in sum is cut in two, from the two halves of its main axis, unless that leaves less than LEAST_SHARE of all rows on one side; so no centroid stands for a single odd text."""

    def centroid(rows: np.ndarray) -> np.ndarray:
        c = x[rows].mean(axis=0)
        return c / max(float(np.linalg.norm(c)), 1e-12)

    least = max(1, int(np.ceil(LEAST_SHARE * len(x))))
    parts, whole = [np.arange(len(x))], set()
    while len(parts) < k:
        spread = [-1.0 if i in whole or len(p) < 2 * least else float((1 - x[p] @ centroid(p)).sum()) for i, p in enumerate(parts)]
        at = int(np.argmax(spread))
        if spread[at] <= 1e-9:
            break
        p = parts[at]
        rest = x[p] - x[p].mean(axis=0)
        axis = rest[int(np.argmax((rest * rest).sum(axis=1)))]
        for _ in range(8):
            axis = rest.T @ (rest @ axis)
            axis /= max(float(np.linalg.norm(axis)), 1e-12)
        side = rest @ axis > 0
        for _ in range(rounds):
            if not side.any() or side.all():
                break
            side = x[p] @ centroid(p[side]) > x[p] @ centroid(p[~side])
        if min(side.sum(), (~side).sum()) < least:
            whole.add(at)
            continue
        parts[at] = p[side]
        parts.append(p[~side])
    c = np.array([centroid(p) for p in parts])
    return c, np.argmax(x @ c.T, axis=1)


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, per_language: int = PER_LANGUAGE, buckets: int = BUCKETS, margin: float = MARGIN) -> Model:
    """Learns from text and lang of `labelled`; rows without a letter or lang are left out. At most about `sample_rows` rows, as evenly over languages as they are, reach the driver, each as one vector of `buckets` counts. All values of lang are learned; where they are many, about `LEAST_ROWS` rows of each are taken, however many that makes."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not n:
        none = np.zeros((0, buckets), np.float32)
        return Model(np.ones(buckets, np.float32), none, (), np.zeros(0))
    share = max(LEAST_ROWS, sample_rows // len(n))
    ticket = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    odds = F.create_map(*(F.lit(x) for lang, m in n.items() for x in (lang, min(1.0, share / m))))
    sample = rows.where(ticket < F.try_element_at(odds, "lang")).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
                if has_letter(text.as_py()):
                    c = counts(text.as_py(), buckets).astype(np.float32)
                    at = np.flatnonzero(c)
                    kept.append((lang.as_py(), at.astype(np.int32).tobytes(), c[at].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.binary()))], names=["lang", "at", "v"])

    got = sample.mapInArrow(tidy(vectors), "lang string, at binary, v binary").collect()
    langs, x = np.array([r["lang"] for r in got]), np.zeros((len(got), buckets), np.float32)
    for row, r in zip(x, got, strict=True):
        row[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["v"], np.float32)
    del got
    # By language, then by the bytes of the counts: the order of rows, and so the model, doesn't depend on that of the table.
    order = np.argsort(x.view(np.dtype((np.void, x.itemsize * buckets))).ravel(), kind="stable")
    order = order[np.argsort(langs[order], kind="stable")]
    langs, idf = langs[order], (np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 1).astype(np.float32)
    np.log1p(x, out=x)
    x *= idf
    for lo in range(0, len(x), 256):
        x[lo : lo + 256] /= np.maximum(np.linalg.norm(x[lo : lo + 256], axis=1, keepdims=True), 1e-12)
    centroids, labels, radius = [], [], []
    for lang in sorted(set(langs.tolist())):
        own = x[order[langs == lang]]
        c, at = _clusters(own, per_language)
        near = (own * c[at]).sum(axis=1)
        for i in range(len(c)):
            centroids.append(c[i])
            labels.append(lang)
            radius.append(max(0.0, float(np.quantile(near[at == i], LOW)) * margin) if (at == i).any() else 0.0)
    x = own = None
    trim()
    return Model(idf, np.array(centroids, np.float32), tuple(labels), np.array(radius))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected. Null texts and texts without a letter are `und`, score 0, rejected; so is everything if nothing was learned. Ties go to the first language in order."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most per_language x languages x buckets floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        buckets = len(m.idf)
        for b in batches:
            texts = b.column("text")
            lang, score, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for lo in range(0, len(texts), 512):
                part = [t.as_py() for t in texts[lo : lo + 512]]
                use = [i for i, t in enumerate(part) if has_letter(t)] if m.labels else []
                if not use:
                    continue
                cos = m.score(np.array([counts(part[i], buckets) for i in use]))
                best = np.argmax(cos, axis=1)
                for i, k, c in zip(use, best, cos[np.arange(len(use)), best], strict=True):
                    lang[lo + i], score[lo + i], out[lo + i] = m.labels[k], min(1.0, max(0.0, float(c))), c < m.radius[k]
            for name in ("lang_pred", "score", "rejected"):
                if name in b.schema.names:
                    b = b.drop_columns([name])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=[*b.schema.names, "lang_pred", "score", "rejected"])

    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "rejected")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double, rejected boolean")


def held_out():
    """True where crc32 of doc_id as text leaves 1 modulo 3; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
