"""Operator 7. Exact Jaccard self-join on word n-grams, with a count-vector R-tree.

A document's n-grams are hashed into groups, more for larger documents; the counts are a point. For two documents the sum of the
coordinate minima bounds the overlap from above, and so it does for a point and the upper corner of a box of points:
a tree of such boxes is searched for partners, and what survives is verified on the texts.

What meets in a tree is decided by prefixes: with any fixed order of n-grams, two sets of Jaccard similarity >= t share
one of the first n - ceil(t n) + 1 of either. n-grams go by how often a count sketch of fixed size saw them, then by
hash, so frequent ones come last. Equal sets are one node. First each node is verified against one leader of each
prefix n-gram; the links give components. Nodes whose prefix n-grams still join several of them are then verified
against two leaders of each of `BANDS` keys, taken from their least n-grams beyond fixed points, which similar sets
mostly share; that joins most of what belongs together. Nodes meet at an n-gram only within a run of sizes, ordered, of which
each is near enough to the one before. In the end only pairs of different components that share a
prefix n-gram go through the trees. No pair is left out but those that the bound excludes or whose components are one
already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipyard.llm.common import gram_hashes, mix, only_near, partitions, row_key, scratch, table, tidy, word_hashes
from clipyard.llm.graph import components

WIDTH, BLOCK = 1 << 20, 1 << 12
SLICE, FAN, CHUNK = 4096, 16, 1024
BANDS, PICKS, LOWS = 12, 4, 8
_POINTS = np.arange(BANDS * PICKS, dtype=np.uint64) * np.uint64((1 << 64) // (BANDS * PICKS))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words of a text; of all words where it has fewer."""
    words, _, _ = word_hashes(b" ".join((text or "").encode().lower().split()))
    return np.unique(gram_hashes(words, n))


def groups(n: int) -> int:
    """Number of groups for a set of n, a power of two: more than n up to 2048; beyond that (a large set has as many rows of as long vectors) as many, until two to four n-grams fall in one."""
    bits = int(n).bit_length()
    return 1 << max(5, min(bits, 11), min(15, bits - 2))


def packed_counts(s: np.ndarray) -> bytes:
    """Counts of the n-grams in their groups (the leading bits of the hash), four bits each; 15 stands for more than 14, and for all where one has more than 254."""
    d = groups(len(s))
    n = np.bincount((s >> np.uint64(65 - d.bit_length())).astype(np.int64), minlength=d)
    n = (np.minimum(n, 15) if n.max(initial=0) < 255 else np.full(d, 15)).astype(np.uint8)
    return (n[::2] << 4 | n[1::2]).tobytes()


def folded(packed: list[bytes], d: int) -> np.ndarray:
    """Count vectors in d groups, a row each, of vectors in as many or more: neighbours are added up. No count is less than the true one; a row that begins with 255 excludes nothing."""
    out, size = np.empty((len(packed), d), np.uint8), np.array([len(x) for x in packed])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        pairs = np.frombuffer(b"".join([packed[i] for i in at]), np.uint8).reshape(len(at), n)
        v = np.stack([pairs >> 4, pairs & 15], axis=2).reshape(len(at), 2 * n)
        v[v == 15] = 255
        if 2 * n != d:
            v = v.reshape(len(at), d, -1).sum(axis=2)
            v[v.max(axis=1) >= 255] = 255
        out[at] = v
    return out


def bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap, row by row: the sum of the minima."""
    low = np.minimum(x, y)
    return np.where(low[:, 0] == 255, 1 << 40, low.sum(axis=1, dtype=np.int64))


def band_keys(s: np.ndarray) -> np.ndarray:
    """Keys of a set (sorted hashes): each of the n-grams next beyond PICKS of the fixed points. Two sets share one with about their similarity to the power PICKS."""
    if not len(s):
        return np.zeros(0, np.int64)
    picks = s[np.searchsorted(s, _POINTS) % len(s)].reshape(BANDS, PICKS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(PICKS):
        key = mix(key + picks[:, i])
    return np.unique(key.view(np.int64))


def least_overlap(total: np.ndarray | int, percent: int):
    """Least intersection of two sets of `total` elements together with 100 I >= percent U."""
    return -(-percent * total // (100 + percent))


# --- the tree -----------------------------------------------------------------------------------


class CountTree:
    """R-tree over count vectors, packed by size, then by the coordinate that varies most; a box keeps its upper corner and its least and largest size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int, fan: int = FAN):
        self.percent, self.fan = percent, fan
        order = np.argsort(sizes, kind="stable")
        slab = fan * max(1, int(np.sqrt(len(sizes) / fan)))
        axis = int(np.argmax(points.astype(np.float32).var(axis=0))) if len(sizes) > fan else 0
        order = np.concatenate([s[np.argsort(points[s, axis], kind="stable")] for s in (order[i : i + slab] for i in range(0, len(order), slab))]) if len(order) else order
        self.order = order
        self.levels = [(points[order], sizes[order], sizes[order])]
        while len(self.levels[-1][0]) > fan:
            upper, least, most = self.levels[-1]
            at = np.arange(0, len(upper), fan)
            self.levels.append((np.maximum.reduceat(upper, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def search(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) index pairs whose sizes and bound allow the similarity."""
        room = max(64, (1 << 22) // max(1, points.shape[1]))
        found_q, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        stack = [(len(self.levels) - 1, np.repeat(np.arange(len(sizes)), len(self.levels[-1][0])), np.tile(np.arange(len(self.levels[-1][0])), len(sizes)))]
        while stack:
            level, q, p = stack.pop()
            if len(q) > room:
                stack += [(level, q[i : i + room], p[i : i + room]) for i in range(0, len(q), room)]
                continue
            upper, least, most = self.levels[level]
            keep = (100 * most[p] >= self.percent * sizes[q]) & (100 * sizes[q] >= self.percent * least[p])
            q, p = q[keep], p[keep]
            keep = bound(points[q], upper[p]) >= least_overlap(sizes[q] + least[p], self.percent)
            q, p = q[keep], p[keep]
            if level == 0:
                found_q.append(q)
                found_p.append(self.order[p])
            elif len(q):
                below = len(self.levels[level - 1][0])
                child = (p[:, None] * self.fan + np.arange(self.fan)).ravel()
                q = np.repeat(q, self.fan)
                inside = child < below
                stack.append((level - 1, q[inside], child[inside]))
        return np.concatenate(found_q), np.concatenate(found_p)


# --- passes over the texts ----------------------------------------------------------------------


def node_of(s: np.ndarray) -> int:
    """The hash of a set that stands for it."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _emit_nodes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, before = np.zeros(WIDTH, np.int64), set()
        names = ["block", "doc_id", "k_id", "k_text", "node", "n", "vec", "keys"]
        for b in batches:
            nodes, sizes, vecs, keys = [], [], [], []
            for value in b.column("text"):
                s = shingles(value.as_py(), n)
                nodes.append(node_of(s))
                sizes.append(len(s))
                new = nodes[-1] not in before  # copies of what this task has had need no point of their own
                before.add(nodes[-1])
                vecs.append(packed_counts(s) if new else None)
                keys.append(band_keys(s) if new else None)
                if new:
                    np.add.at(sketch, (s & np.uint64(WIDTH - 1)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(nodes), pa.int32()), *(b.column(c) for c in names[1:4]), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(vecs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=names)
        blocks = sketch.reshape(-1, BLOCK)
        use = np.flatnonzero(blocks.any(axis=1))
        if len(use):
            none = pa.nulls(len(use), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), none, none, none, none, none, pa.array([blocks[i].astype("<i4").tobytes() for i in use], pa.binary()), pa.nulls(len(use), pa.list_(pa.int64()))], names=names)

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the sketch rows of one partition; the partition holds all rows of its blocks."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, v in zip(b.column("block").to_pylist(), b.column("vec"), strict=True):
            a = np.frombuffer(v.as_py(), "<i4").astype(np.int64)
            total[i] = total[i] + a if i in total else a
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(v, 2**31 - 1).astype("<i4").tobytes() for v in total.values()], pa.binary())], names=["block", "vec"])


def _prefixes(n: int, percent: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sketch.value
        usual = 4 * max(1.0, float(seen.mean()))
        before = set()
        for b in batches:
            hashes, nodes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for value in b.column("text"):
                s = shingles(value.as_py(), n)
                node = node_of(s)
                if not len(s) or node in before:
                    continue
                before.add(node)
                heat = np.log2(np.maximum(1.0, seen[(s & np.uint64(WIDTH - 1)).astype(np.int64)] / usual)).astype(np.int64)
                take = len(s) - -(-percent * len(s) // 100) + 1
                hashes.append(s[np.lexsort((s, heat))[:take]] if heat.any() else s[:take])
                nodes.append(np.full(take, node, np.int64))
                sizes.append(np.full(take, len(s)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([h.view(np.int64) for h in hashes], nodes, sizes)], names=["h", "node", "n"])

    return run


# --- candidate pairs ----------------------------------------------------------------------------


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, m = (b.column(c).to_numpy() for c in ("n_u", "n_v"))
            keep = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            least = least_overlap(n + m, percent)
            for i in np.flatnonzero(keep):
                x, y = b.column("vec_u")[i].as_py(), b.column("vec_v")[i].as_py()
                d = 2 * min(len(x), len(y))
                keep[i] = bound(folded([x], d), folded([y], d))[0] >= least[i]
            yield b.select(["u", "v"]).filter(pa.array(keep))

    return run


@dataclass(frozen=True)
class Rows:
    """Rows of one n-gram, band and slice: nodes, their components, sizes, packed vectors and least n-grams (LOWS each, filled up with the largest value)."""

    node: np.ndarray
    comp: np.ndarray
    n: np.ndarray
    vec: list[bytes]
    lows: np.ndarray


_LAST = np.iinfo(np.int64).max


def _rows_of(batch: pa.RecordBatch) -> Rows:
    lows = np.full((batch.num_rows, LOWS), _LAST)
    for i, own in enumerate(batch.column("lows").to_pylist()):
        lows[i, : len(own)] = own
    return Rows(*(batch.column(c).to_numpy() for c in ("node", "comp", "n")), batch.column("vec").to_pylist(), lows)


def _joined(parts: list[Rows]) -> Rows:
    return Rows(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("node", "comp", "n")), [v for p in parts for v in p.vec], np.concatenate([p.lows for p in parts]))


def _crossing(h: int, tree: CountTree, held: Rows, d: int, probe: Rows, within: bool) -> pa.RecordBatch:
    """Pairs of probes and rows of the tree, of different components, that the bound allows. A pair is put out at its least common n-gram: not here where both are seen to share a lesser one."""
    q, p = tree.search(folded(probe.vec, d), probe.n)
    keep = probe.comp[q] != held.comp[p]
    if within:
        keep &= probe.node[q] < held.node[p]
    q, p = q[keep], p[keep]
    for lo in range(0, len(q), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        x, y = probe.lows[q[part]], held.lows[p[part]]
        lesser = ((x[:, :, None] == y[:, None, :]) & (x < h)[:, :, None]).any(axis=(1, 2))
        u, v = probe.node[q[part]][~lesser], held.node[p[part]][~lesser]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def _trees(percent: int):
    """Rows come by n-gram, band and slice, those of the tree (role 0) first; the others are read in passing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, held, tree, d = None, [], None, None, 0

        def planted() -> Iterator[pa.RecordBatch]:
            """Makes the tree of the rows gathered and searches it with them."""
            nonlocal held, tree, d
            held, d = _joined(parts), 2 * min(len(v) for p in parts for v in p.vec)
            parts.clear()
            tree = CountTree(folded(held.vec, d), held.n, percent)
            if (held.comp != held.comp[0]).any():
                for lo in range(0, len(held.n), CHUNK):
                    part = slice(lo, lo + CHUNK)
                    yield from _crossing(key[0], tree, held, d, Rows(held.node[part], held.comp[part], held.n[part], held.vec[part], held.lows[part]), True)

        for b in batches:
            if not b.num_rows:
                continue
            names = ("h", "band", "slice", "role")
            at = np.stack([b.column(c).to_numpy().astype(np.int64) for c in names], axis=1)
            edge = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, [len(at)]])
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                *new, role = at[lo].tolist()
                if new != key:
                    if parts:
                        yield from planted()
                    key, held, tree = new, None, None
                    parts.clear()
                if not role:
                    parts.append(_rows_of(b.slice(lo, hi - lo)))
                    continue
                if parts:
                    yield from planted()
                for i in range(lo, hi if tree else lo, CHUNK):
                    probe = _rows_of(b.slice(i, min(CHUNK, hi - i)))
                    if (probe.comp != held.comp[0]).any() or (held.comp != held.comp[0]).any():
                        yield from _crossing(key[0], tree, held, d, probe, False)
        if parts:
            yield from planted()

    return run


def _verified(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, last, held = [], None, None
            for u, x, y in zip(b.column("u").to_pylist(), b.column("text_u"), b.column("text_v"), strict=True):
                if u != last:
                    last, held = u, shingles(x.as_py(), n)
                other = shingles(y.as_py(), n)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(held) + len(other) - both))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(docs: DataFrame, reps: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes whose texts are similar enough."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = reps.join(ends, "node")
    near = only_near(docs.select("text", *row_key()), wanted, "k_text")
    texts = scratch(near.join(wanted, ["k_id", "k_text"]).select("node", "text").dropDuplicates(["node"]), "ngram-texts")
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    joined = pairs.join(side("v"), "v").join(side("u"), "u")
    return joined.select("u", "v", "text_u", "text_v").mapInArrow(tidy(_verified(n, percent)), "u long, v long")


def similar(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, node (hash of its set) and root (least node that links reach).

    Words are maximal runs without ASCII white space, A-Z lower-cased. Sets of a document without words or text are empty
    and link with nothing: root is null.
    """
    spark = docs.sparkSession
    found = scratch(docs.select("doc_id", "text", *row_key()).mapInArrow(tidy(_emit_nodes(n)), "block int, doc_id long, k_id long, k_text long, node long, n long, vec binary, keys array<long>"), "ngram-nodes")
    parts = found.where(F.col("block").isNotNull()).select("block", "vec").repartition(min(16, partitions(spark)), "block").mapInArrow(tidy(_sum_blocks), "block int, vec binary").collect()
    seen = np.zeros(WIDTH, np.int64)  # WIDTH counts whatever the corpus
    for r in parts:
        seen[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["vec"], "<i4")
    sketch = spark.sparkContext.broadcast(seen.astype(np.int32))

    rows = docs.select("text").mapInArrow(tidy(_prefixes(n, percent, sketch)), "h long, node long, n long")
    w = Window.partitionBy("h")
    met = rows.repartition(partitions(spark), "h").groupBy("h", "node", "n").agg(F.lit(1).alias("one")).select("h", "node", "n", F.count("*").over(w).alias("met"))
    # Rows of an n-gram by size: where the next is too large for the one before, so are all after it for all before it, and a new group begins.
    by_size = w.orderBy("n", "node")
    step = met.where("met > 1").withColumn("step", (100 * F.lag("n").over(by_size) < percent * F.col("n")).cast("int"))
    grouped = step.withColumn("chain", F.coalesce(F.sum("step").over(by_size), F.lit(0)))
    own = Window.partitionBy("h", "chain")
    met = grouped.select("h", "chain", "node", "n", F.count("*").over(own).alias("met"), F.min(F.struct("node", "n")).over(own).alias("leader")).where("met > 1")
    met = scratch(met.select(F.xxhash64("h", "chain").alias("h"), "node", "n", "met", "leader"), "ngram-met")

    nodes = found.where(F.col("block").isNull() & (F.col("n") > 0)).groupBy("node").agg(F.min(F.struct("k_id", "k_text")).alias("rep"), F.first("vec", True).alias("vec"), F.first("n").alias("n"), F.first("keys", True).alias("keys"))
    nodes = scratch(nodes, "ngram-points")
    point = lambda c: nodes.select(F.col("node").alias(c), F.col("vec").alias(f"vec_{c}"), F.col("n").alias(f"n_{c}"))
    reps = nodes.select("node", "rep.*")

    def bounded(pairs: DataFrame, name: str) -> DataFrame:
        return scratch(pairs.join(point("u"), "u").join(point("v"), "v").mapInArrow(tidy(_bounded(percent)), "u long, v long"), name)

    def across(roots: DataFrame) -> DataFrame:
        """Rows of met whose n-gram joins several components. Groups of two were settled by their star."""
        rest = met.where("met > 2").join(roots, "node", "left").select("h", "node", "n", "met", F.coalesce("root", "node").alias("comp"))
        return rest.withColumns({"lo": F.min("comp").over(w), "hi": F.max("comp").over(w)}).where("lo <> hi").drop("lo", "hi")

    def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
        """Links with the same components as all that gave roots, and these: of a component settled before, each node keeps one link."""
        return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links)

    pair = lambda x, y: (F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    stars = bounded(met.where("node <> leader.node").where(100 * F.least("n", "leader.n") >= percent * F.greatest("n", "leader.n")).select(*pair("node", "leader.node")).distinct(), "ngram-stars")
    links = scratch(_verify(docs, reps, stars, n, percent), "ngram-links")
    roots = components(links)
    apart = scratch(across(roots).select("node", "comp").distinct(), "ngram-apart")

    keyed = apart.join(nodes.select("node", "keys"), "node").select("node", "comp", F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(F.min(F.struct("node", "comp")).alias("a"), F.max(F.struct("node", "comp")).alias("b")).where("a.node <> b.node")
    led = keyed.join(ends, "key").select("node", "comp", F.explode(F.array("a", "b")).alias("x")).where("comp <> x.comp")
    more_stars = bounded(led.select(*pair("node", "x.node")).distinct().join(stars, ["u", "v"], "left_anti"), "ngram-more-stars")
    roots = components(joined(roots, _verify(docs, reps, more_stars, n, percent)))
    rest = across(roots)

    # Bands of sizes by powers of two: a row's partners of no greater size are in its own band, or in those below down to that of percent of its size.
    in_band = lambda x: F.length(F.bin(x))
    band, below = in_band(F.col("n")), in_band(F.greatest(F.lit(1), F.floor(F.col("n") * percent / 100)))
    slices = F.ceil(F.col("met") / SLICE).cast("int")
    own = F.pmod(F.xxhash64("node"), slices).cast("int")
    at = lambda b, s, role: F.struct(b.alias("band"), s.alias("slice"), F.lit(role).alias("role"))
    # A row is in the tree of one slice of its own band. It probes that, the slices after it, and all those of the bands below.
    here = F.transform(F.sequence(own, slices - 1), lambda s: F.when(s == own, at(band, s, 0)).otherwise(at(band, s, 1)))
    bands = F.when(below < band, F.sequence(below, band - 1)).otherwise(F.array().cast("array<int>"))
    there = F.flatten(F.transform(bands, lambda b: F.transform(F.sequence(F.lit(0), slices - 1), lambda s: at(b, s, 1))))
    lows = rest.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("h")), 1, LOWS).alias("lows"))
    placed = rest.select("h", "node", "n", "comp", F.inline(F.concat(here, there))).join(nodes.select("node", "vec").join(lows, "node"), "node")
    keys = ["h", "band", "slice"]
    crossed = placed.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "role").mapInArrow(tidy(_trees(percent)), "u long, v long").distinct()
    crossed = scratch(crossed.join(stars.union(more_stars), ["u", "v"], "left_anti"), "ngram-crossed")
    final = components(joined(roots, _verify(docs, reps, crossed, n, percent)))
    return found.where(F.col("block").isNull()).join(final, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), "node", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root"))


def component_ids(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of docs. component_id is the smallest doc_id reachable by links, the row's own included."""
    held = scratch(similar(docs, n, percent), "ngram-held")
    least = held.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least"))
    return held.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that link, directly or over others, to a document of smaller doc_id. Documents without words stay. Rows that repeat a kept doc_id stay; rows without doc_id stay only where nothing links them to a row with one."""
    ids = component_ids(docs, n, percent)
    keep = ids.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id").distinct()
    return docs.join(keep.withColumnRenamed("doc_id", "clipyard_keep"), F.col("doc_id").eqNullSafe(F.col("clipyard_keep")), "left_semi")


ORACLE = """
WITH RECURSIVE t AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '') AS w FROM t),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * m >= 85 * (x.n + y.n - m)),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.v) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.u = d.doc_id GROUP BY ALL
"""


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_ids(table(spark, sf_dir, "documents"), 4, 85)
