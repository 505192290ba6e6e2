"""Operator 13. Ranked lexical search, term at a time over short lists and document at a time over long ones.

The documents become segments: rows with the lengths of some documents and, for every term that a query holds, its
postings (places, occurrences). Segments are what the documents' partitions already hold, so nothing is shuffled; the
corpus counts (documents, terms, document frequencies of the queries' terms) are sums over them. A query searches a
segment like this:

* lists that are short in the segment are summed term at a time, into accumulators (place, sum) sorted by place;
* the accumulators then stand as one more list, with the largest sum of each block of places as its bound, beside the
  long lists with the bounds of theirs;
* document at a time, blocks in which the bounds together can't pass the tenth best score so far are skipped, the
  blocks of the highest bounds come first, and in the others each document's scores are looked up in every list.

What was best in a task's earlier segments is the bar for its later ones, and the tasks' best ten are merged in two
steps. All arithmetic is on whole numbers, so the ranks are exact whatever the partitioning.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipyard.llm.common import scratch, table, tidy

BEST = 10
#: Characters of queries searched for in one pass over the documents; a task holds BEST scores of each.
BLOCK_CHARS = 16_000_000
SCALE, LENGTH = 1_000_000_000, 90

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of digits, A-Z, a-z and all beyond ASCII, with A-Z in lower case."""
    return text.encode().translate(_TERM).split() if text else []


@dataclass(frozen=True)
class Queries:
    """Terms by number, and for each item its id and the numbers of its terms."""

    number: dict[bytes, int]
    ids: list
    terms: list[np.ndarray]


@dataclass(frozen=True)
class Shape:
    """Documents and characters of a segment; places of a block; a list is short if it has no more postings than this share of the segment's documents. None of them changes a result."""

    rows: int = 4096
    chars: int = 8_000_000
    block: int = 128
    short: float = 1 / 16


def _blocks(items: DataFrame, block_chars: int) -> Iterator[Queries]:
    """The items in blocks of about `block_chars` characters, by hash of their ids; rows of one item_id are one item, with the terms of all."""
    rows = items.where(F.col("text").isNotNull()).select("item_id", "text")
    n = -(-(rows.agg(F.sum(F.char_length("text"))).first()[0] or 0) // block_chars)
    for i in range(n):
        number: dict[bytes, int] = {}
        held: dict = {}
        for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect():  # block_chars bounds it
            held.setdefault(r["item_id"], set()).update(number.setdefault(t, len(number)) for t in terms(r["text"]))
        ids = [k for k, own in held.items() if own]
        yield Queries(number, ids, [np.array(sorted(held[k]), np.int64) for k in ids])


SEGMENT = "doc_id array<long>, n array<long>, term array<int>, df array<int>, place array<int>, tf array<int>"


def segments(docs: DataFrame, number: dict[bytes, int], shape: Shape = Shape()) -> DataFrame:
    """Rows of documents and postings: doc_id and n (terms with repeats) by place; term (numbers in `number`) with df each, and place and tf of their postings one after another."""
    held = docs.sparkSession.sparkContext.broadcast(number)

    def segment(ids: list, sizes: list, found: dict[int, list[tuple[int, int]]]) -> pa.RecordBatch:
        own = sorted(found)
        columns = (ids, pa.int64()), (sizes, pa.int64()), (own, pa.int32()), ([len(found[t]) for t in own], pa.int32()), ([p for t in own for p, _ in found[t]], pa.int32()), ([f for t in own for _, f in found[t]], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([c], pa.list_(kind)) for c, kind in columns], names=["doc_id", "n", "term", "df", "place", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value.keys()
        ids, sizes, found, chars = [], [], {}, 0
        for b in batches:
            for doc_id, value in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = value.as_py()
                own = Counter(terms(text))
                for t in own.keys() & known:
                    found.setdefault(held.value[t], []).append((len(ids), own[t]))
                ids.append(doc_id)
                sizes.append(own.total())
                chars += len(text or "")
                if len(ids) == shape.rows or chars >= shape.chars:
                    yield segment(ids, sizes, found)
                    ids, sizes, found, chars = [], [], {}, 0
        if ids:
            yield segment(ids, sizes, found)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SEGMENT)


class Best:
    """The highest scores so far, ties by smaller doc_id (null last); the last of them is the bar."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def bar(self) -> int:
        """What a document must reach to come in: the last score while the list is full (a tie can still win by its id), else 1."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        new = [(int(s), i) for s, i in zip(scores, ids, strict=True)]
        self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1] is None, r[1]))[: self.k]


def search_segment(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: list, best: Best, shape: Shape = Shape()) -> int:
    """Adds a segment's documents to best. lists: (places in order, scores, largest score of each block) of the query's terms. Returns the number of documents that were scored."""
    n, block = len(ids), shape.block
    most = max(1, n * shape.short)
    short = [x for x in lists if len(x[0]) <= most]
    iterators = [x for x in lists if len(x[0]) > most]
    if short:  # term at a time
        place, at = np.unique(np.concatenate([x[0] for x in short]), return_inverse=True)
        total = np.zeros(len(place), np.int64)
        np.add.at(total, at, np.concatenate([x[1] for x in short]))
        top = np.zeros(-(-n // block), np.int64)
        np.maximum.at(top, place // block, total)
        iterators.append((place, total, top))
    if not iterators:
        return 0
    bound = np.sum([x[2] for x in iterators], axis=0)
    scored = 0
    for b in np.argsort(-bound, kind="stable").tolist():  # document at a time, the most promising blocks first
        if bound[b] < best.bar():
            break
        sums = np.zeros(block, np.int64)
        for place, score, top in iterators:
            if top[b]:
                lo, hi = np.searchsorted(place, (b * block, (b + 1) * block))  # skips to the block
                sums[place[lo:hi] - b * block] += score[lo:hi]
        scored += int((sums > 0).sum())
        good = np.flatnonzero(sums >= best.bar())
        if len(good):
            best.add(sums[good], [ids[b * block + g] for g in good.tolist()])
    return scored


def rank(docs: DataFrame, items: DataFrame, k: int = BEST, block_chars: int = BLOCK_CHARS, shape: Shape = Shape()) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item with a score above 0; equal scores by ascending doc_id, null last.

    A term's weight w is floor(1000 ln((2N + 2) / (2df + 1))); a document's m is 100 - LENGTH + (LENGTH n N) div L; the
    score sums w ((SCALE tf) div (1000 tf + 8 m)) over the item's terms. Documents without text have no terms; each row
    is a document of its own, so repeated rows take a rank each. Items without terms have no rows; an empty table on
    either side gives none.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for q in _blocks(items, block_chars):
        if q.ids:
            out = out.unionByName(_ranked(docs, q, k, shape))
    return out


def _ranked(docs: DataFrame, q: Queries, k: int, shape: Shape) -> DataFrame:
    spark = docs.sparkSession
    held = scratch(segments(docs, q.number, shape), "segments")
    counts = held.agg(F.sum(F.size(F.filter("n", lambda n: n > 0))).alias("docs"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, n: a + n)).alias("terms")).first()
    n_docs, n_terms = counts["docs"] or 0, counts["terms"] or 0
    found = held.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df")).collect()  # the block's terms at most
    weight = np.zeros(len(q.number), np.int64)
    for r in found:
        weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    told = spark.sparkContext.broadcast((weight, q.ids, q.terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, ids, wanted = told.value
        best = [Best(k) for _ in ids]
        for b in batches:
            for i in range(b.num_rows):
                doc_id = b.column("doc_id")[i].as_py()
                n, term, df, place, tf = (b.column(c)[i].values.to_numpy().astype(np.int64) for c in ("n", "term", "df", "place", "tf"))
                m = 100 - LENGTH + (LENGTH * n * n_docs) // max(1, n_terms)
                score = np.repeat(weight[term], df) * (SCALE * tf // (1000 * tf + 8 * m[place]))
                ends = np.cumsum(df)
                tops = np.zeros((len(term), -(-len(n) // shape.block)), np.int64)
                np.maximum.at(tops, (np.repeat(np.arange(len(term)), df), place // shape.block), score)
                row = np.full(len(weight), -1)
                row[term] = np.arange(len(term))
                for own, top in zip(wanted, best, strict=True):
                    at = row[own]
                    at = at[(at >= 0) & (weight[own] > 0)]
                    search_segment([(place[ends[a] - df[a] : ends[a]], score[ends[a] - df[a] : ends[a]], tops[a]) for a in at.tolist()], doc_id, top, shape)
        rows = [(i, d, s) for i, top in zip(ids, best, strict=True) for s, d in top.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "score"])

    each = held.mapInArrow(tidy(run), "item_id long, doc_id long, score long").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return first(first(each, "item_id", "part"), "item_id").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc_id), total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
