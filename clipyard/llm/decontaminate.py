"""Operator 2. Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment over words.

Every n-gram of a test item is a seed. None is left out for being common in the corpus: how often an n-gram stands
there depends on how often, and how whole, its item leaked. Where two seeds of an item stand close together in a text (two
trigrams: all that share four words in a row do, and most copies with a fifth of the words changed), the passage around them is aligned with the item, edits and gaps allowed; the score over the item's length decides.

The items are held in memory in blocks of at most `BLOCK_CHARS` characters; each block is searched in all texts, so a
large benchmark takes more passes and not more memory. Nothing of the corpus is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipyard.llm.common import gram_hashes, prefix_hash, span_hash, table, tidy

GRAM, MATCH, MISMATCH, GAP, THRESHOLD = 3, 1, -1, -1, 0.5
BLOCK_CHARS = 16 << 20
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))


def words(text: str | None) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters, digits and bytes beyond ASCII, A-Z lower-cased), the folded bytes and each word's start and end there."""
    raw = (text or "").encode().translate(_FOLD)
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], data != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    return span_hash(prefix_hash(data), start, end) if len(start) else np.zeros(0, np.uint64), raw, start, end


@dataclass(frozen=True)
class Items:
    """A block of test items: words of each, and its seeds as sorted hashes with the item and place of each."""

    ids: np.ndarray
    words: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray


def items_of(rows: list[tuple[int, str]], gram: int = GRAM) -> Items:
    """Rows of one block; items without words give no seeds, items of fewer than `gram` words one."""
    split = [words(text)[0] for _, text in rows]
    grams = [gram_hashes(w, gram) for w in split]
    seeds = np.concatenate([np.zeros(0, np.uint64), *grams])
    item = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
    order = np.argsort(seeds, kind="stable")
    return Items(np.array([r[0] for r in rows], np.int64), split, seeds[order], item[order], place[order])


def _hits(own: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Indices into own of the hashes that are among the sorted seeds."""
    if not len(seeds) or not len(own):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(seeds, own), len(seeds) - 1)
    return np.flatnonzero(seeds[at] == own)


def align(item: np.ndarray, passages: np.ndarray, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman score of one item against each row of `passages` (word hashes, 0 where padded), and the last column of the best alignment. The gap along the passage is a running maximum, so a whole row of all matrices is one step."""
    n, m = passages.shape
    ramp = -gap * np.arange(m + 1)
    row = np.zeros((n, m + 1), np.int32)
    best, where = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for w in item:
        step = np.where(passages == w, match, mismatch)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] + gap), 0)
        new = np.maximum.accumulate(new + ramp, axis=1) - ramp
        at = new.argmax(axis=1)
        top = new[np.arange(n), at]
        better = top > best
        best[better], where[better] = top[better], at[better]
        row = new.astype(np.int32)
    return best, where


def _passages(own: np.ndarray, items: Items, gram: int) -> Iterator[tuple[int, int, int]]:
    """(item, first word, end) of the stretches around two of its seeds or more (one, where it has no more), each as long as the item with half of it to spare on both sides; close ones are one."""
    grams = gram_hashes(own, gram)
    at = _hits(grams, items.seeds)
    if not len(at):
        return
    lo, hi = np.searchsorted(items.seeds, grams[at]), np.searchsorted(items.seeds, grams[at], side="right")
    rows = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    item, start = items.item[rows], np.repeat(at, hi - lo) - items.place[rows]
    order = np.lexsort((start, item))
    item, start = item[order], start[order]
    first = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (start[1:] - start[:-1] > np.array([len(items.words[i]) // 2 + 1 for i in item[1:]]))]))
    for a, b in zip(first, np.append(first[1:], len(item)), strict=True):
        n = len(items.words[item[a]])
        if b - a < min(2, n - gram + 1):
            continue
        yield int(item[a]), max(0, int(start[a]) - n // 2 - 1), min(len(own), int(start[b - 1]) + n + n // 2 + 1)


def _search(items, gram: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = items.value
        for b in batches:
            rows: dict[tuple[int, int], tuple] = {}
            for lo in range(0, b.num_rows, 256):
                todo: dict[int, list] = {}
                for k, value in enumerate(b.column("text")[lo : lo + 256], lo):
                    own, raw, start, end = words(value.as_py())
                    for i, first, stop in _passages(own, held, gram):
                        todo.setdefault(i, []).append((k, own[first:stop], first))
                for i, found in todo.items():
                    n = len(held.words[i])
                    width = max(len(f[1]) for f in found)
                    table_ = np.zeros((len(found), width), np.uint64)
                    for r, f in enumerate(found):
                        table_[r, : len(f[1])] = f[1]
                    score, end_at = align(held.words[i], table_)
                    for (k, _, first), s, e in zip(found, score / (MATCH * n), end_at, strict=True):
                        if s >= threshold and (old := rows.get((k, i))) is None or s >= threshold and s > old[0]:
                            rows[k, i] = (float(s), first + int(e))
            keys = sorted(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array([k for k, _ in keys], pa.int64())), b.column("k_text").take(pa.array([k for k, _ in keys], pa.int64())), pa.array([int(held.ids[i]) for _, i in keys], pa.int64()), pa.array([rows[k][0] for k in keys], pa.float64()), pa.array([rows[k][1] for k in keys], pa.int64())],
                names=["doc_id", "k_text", "item_id", "score", "end_word"],
            )

    return run


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `block_chars` characters, by hash; rows without item_id or text are left out."""
    rows = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    total = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for i in range(n):
        yield [(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, k_text (hash of the text), item_id, score, end_word of each passage that scores `threshold` or more: the best of each document and item.

    Null texts hold nothing; an empty benchmark finds nothing. Rows are searched one by one, so repeated ones give the same.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("k_text"), "text")
    out = spark.createDataFrame([], "doc_id long, k_text long, item_id long, score double, end_word long")
    for rows in _blocks(benchmark, block_chars):
        held = spark.sparkContext.broadcast(items_of(rows, gram))  # block_chars bounds it
        out = out.union(texts.mapInArrow(tidy(_search(held, gram, threshold)), "doc_id long, k_text long, item_id long, score double, end_word long"))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """docs without those that hold a passage of an item; columns stay as they are."""
    dirty = leaks(docs, benchmark, threshold, gram).select(F.coalesce("doc_id", F.lit(-1)).alias("clipyard_id"), F.col("k_text").alias("clipyard_text")).distinct()
    own = (F.coalesce(F.col("doc_id"), F.lit(-1)) == F.col("clipyard_id")) & (F.xxhash64("text") == F.col("clipyard_text"))
    return docs.join(dirty, own, "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k_text")
