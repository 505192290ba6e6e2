"""Operator 6. Exact substring dedup: every byte inside a `length`-byte string that starts at two places or more goes.

A `length`-byte window is represented by its anchor: the leftmost of the least k-gram hashes in it (k = `gram`). Equal
windows have equal anchors at equal offsets, so two copies meet where their anchors' suffixes meet, and one suffix in
about 70 positions is enough. The steps:

1. Each text gives its anchors, with the range of window starts each stands for. Anchors whose k-gram hash occurs once
   in the corpus are dropped; their windows occur once.
2. Each task sorts the suffixes of its remaining anchors (with what stands left of them), and writes them as sorted
   runs, front-coded: length of the prefix shared with the suffix before, then the rest. Equal ones become one entry
   with several occurrences. The runs are cut at splitters of the first eight bytes and exchanged.
3. Each range of suffixes merges its runs with a loser tree whose nodes keep the known common prefix with the last
   winner, so bytes known to be equal are never compared again; the merge yields the LCP array.
4. The LCP arrays of the suffixes and of the reversed left contexts number the classes of strings that agree to the
   right for `length - d` bytes and to the left for d; an entry in a class of two occurrences marks its window at d.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipyard.llm.common import mix, partitions, prefix_hash, row_key, scratch, span_hash, table

LENGTH, GRAM = 200, 64
_CHUNK = 1 << 22
_RUN, _RANGE = 200_000, 20_000


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position and k-gram hash of the anchors of a text, and the first and last window start each stands for."""
    parts = []
    for at in range(0, max(1, len(data) - length + 1), _CHUNK):
        piece = data[at : at + _CHUNK + length - 1]
        if len(piece) < length:
            break
        start = np.arange(len(piece) - gram + 1)
        hashes = span_hash(prefix_hash(piece), start, start + gram)
        key = (hashes >> np.uint64(23)) << np.uint64(23) | start.astype(np.uint64)  # least hash, then leftmost
        width, least, span = length - gram + 1, key, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        pos = (least & np.uint64((1 << 23) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
        last = np.append(first[1:] - 1, len(pos) - 1)
        a = pos[first]
        parts.append((a + at, hashes[a], first + at, last + at))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _lead(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as an integer in the strings' order."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | data[at + i]
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def _emit_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks = b.column("k_id").to_numpy(), b.column("k_text").to_numpy()
            out, size = [], 0

            def flush(out=out):
                h, lead, at, left, more, k_id, k_text = (np.concatenate(x) for x in zip(*out, strict=True))
                # Hashes that repeat here are known to; one row of each tells the others, and the rest are dealt out evenly.
                _, first, which, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                known = n[which] > 1
                rest = known.copy()
                rest[first] = False
                h = np.where(rest, mix(h ^ mix(at.astype(np.uint64)) ^ k_id.view(np.uint64)), h)
                return pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), known, lead, k_id, k_text, at, left.astype(np.int32), more.astype(np.int32))], names=["h", "known", "lead", "k_id", "k_text", "at", "left", "more"])

            for i, value in enumerate(b.column("text")):
                data = np.frombuffer((value.as_py() or "").encode(), np.uint8)
                if len(data) < length:
                    continue
                at, h, first, last = anchors(data, length, gram)
                out.append((h, _lead(data, at), at, at - first, last - first, np.full(len(at), ids[i]), np.full(len(at), marks[i])))
                size += len(at)
                if size > 100_000:
                    yield flush()
                    out.clear()
                    size = 0
            if out:
                yield flush()

    return run


# --- front-coded runs ---------------------------------------------------------------------------


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be at least `at`."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    step = 16
    while a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    while step > 1:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return at


def encode(entries: list[tuple[bytes, bytes, list[tuple[int, int, int]]]]) -> bytes:
    """Sorted (right, left, occurrences) as one block; an occurrence is (k_id, k_text, position)."""
    out, before, side = [], b"", b""
    for right, left, where in entries:
        p, q = common(before, right), common(side, left)
        out += [struct.pack("<HHHHI", p, len(right) - p, q, len(left) - q, len(where)), right[p:], left[q:], *(struct.pack("<qqq", *w) for w in where)]
        before, side = right, left
    return b"".join(out)


def decode(block: bytes) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(LCP with the entry before, right, left, packed occurrences) of a block."""
    at, right, left = 0, b"", b""
    while at < len(block):
        p, n, q, m, k = struct.unpack_from("<HHHHI", block, at)
        at += 12
        right = right[:p] + block[at : at + n]
        at += n
        left = left[:q] + block[at : at + m]
        at += m
        yield p, right, left, block[at : at + 24 * k]
        at += 24 * k


def merge(runs: list[Iterator[tuple[int, bytes, bytes, bytes]]]) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Merges sorted runs to (LCP with the entry put out before, right, left, occurrences), by right, then left.

    Each player holds the common prefix of its head with the last winner. In a match the longer one wins unread; equal
    ones are compared from there on, and the loser keeps what the match found as its common prefix with the winner.
    """
    n = max(1, len(runs))
    heads: list = [next(r, None) for r in runs]
    known = [0] * n  # with the last winner
    loser = [-1] * n  # inner nodes 1..n-1; leaf of run i is node n + i

    def beats(a: int, b: int) -> int:
        """The winner; the loser's `known` becomes its common prefix with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return b if x is None else a
        if known[a] != known[b]:
            return a if known[a] > known[b] else b  # what diverged later from the last winner is the lesser; the loser's prefix stays
        at = common(x[1], y[1], known[a])
        first = a if (x[1][at : at + 1], x[2], a) <= (y[1][at : at + 1], y[2], b) else b
        known[b if first == a else a] = at
        return first

    def build(node: int) -> int:
        if node >= n:
            return node - n
        left, right = build(2 * node), build(2 * node + 1)
        win = beats(left, right)
        loser[node] = right if win == left else left
        return win

    if not runs:
        return
    win = build(1) if n > 1 else 0
    while heads[win] is not None:
        _, right, left, where = heads[win]
        yield known[win], right, left, where
        heads[win] = next(runs[win], None)
        if heads[win] is not None:
            known[win] = heads[win][0]  # the run's own front coding: common prefix with the entry just put out
        node = (n + win) // 2
        while node >= 1:
            other = loser[node]
            if other >= 0:
                new = beats(win, other)
                if new != win:
                    loser[node], win = win, new
            node //= 2


def _emit_runs(length: int, splitters: list[int]):
    cuts = np.array(splitters, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], list[tuple[int, int, int]]] = {}

        def flush() -> pa.RecordBatch:
            entries = sorted((right, left, where) for (right, left), where in held.items())
            lead = np.array([int.from_bytes(e[0][:8], "big") for e in entries], np.uint64)
            dest = np.searchsorted(cuts, (lead ^ np.uint64(1 << 63)).view(np.int64), side="right")
            bounds = np.flatnonzero(np.concatenate([[True], dest[1:] != dest[:-1], [True]]))
            return pa.RecordBatch.from_arrays([pa.array([int(dest[lo]) for lo in bounds[:-1]], pa.int32()), pa.array([encode(entries[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["dest", "block"])

        n = 0
        for b in batches:
            ids, marks = b.column("k_id").to_numpy(), b.column("k_text").to_numpy()
            for i, (value, where) in enumerate(zip(b.column("text"), b.column("where"), strict=True)):
                data = (value.as_py() or "").encode()
                for w in where.as_py():
                    at, left, more = w["at"], w["left"], w["more"]
                    right = data[at : at - left + more + length]
                    side = data[at - left : at][::-1]
                    held.setdefault((right, side), []).append((int(ids[i]), int(marks[i]), at))
                    n += 1
                if n >= _RUN:
                    yield flush()
                    held.clear()
                    n = 0
        if held:
            yield flush()

    return run


def _ranks(columns: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte strings, and each one's LCP with the one before in that order."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    lcp = np.zeros(len(columns), np.int64)
    for i in range(1, len(order)):
        lcp[i] = common(columns[order[i - 1]], columns[order[i]])
    return np.array(order, np.int64), lcp


def _repeated(lcp: np.ndarray, n_right: np.ndarray, left: list[bytes], times: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each offset d of the anchor in its window: the entries (in merged order) whose window at d occurs twice or more."""
    n_left = np.array([len(x) for x in left])
    order, side = _ranks(left)
    for d in range(int(n_left.max(initial=-1)) + 1):
        use = np.flatnonzero((n_left >= d) & (n_right >= length - d))
        if not len(use):
            continue
        right_class = np.cumsum(lcp < length - d)[use]
        left_class = np.empty(len(left), np.int64)
        left_class[order] = np.cumsum(side < d)
        both = right_class * (len(left) + 1) + left_class[use]
        _, where, inverse = np.unique(both, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=times[use])
        hit = use[total[inverse] > 1]
        if len(hit):
            yield d, hit


def _emit_repeats(length: int, gram: int):
    def one(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        """The merged range is handled in stretches that share no k-gram, so no class crosses a stretch and the work stays small."""
        lcps, rights, lefts, wheres = [], [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            times = np.array([len(w) // 24 for w in wheres])
            flags = np.zeros((len(lefts), length - gram + 3), np.int8)
            for d, hit in _repeated(np.array(lcps), np.array(rights), lefts, times, length):
                flags[hit, d + 1] = 1
            edge = np.diff(flags, axis=1)
            entry, lo = np.nonzero(edge == 1)
            _, hi = np.nonzero(edge == -1)
            if not len(entry):
                return
            rows = [np.frombuffer(wheres[e], np.int64).reshape(-1, 3) for e in entry]
            counts = np.array([len(r) for r in rows])
            rows = np.concatenate(rows)
            lo, hi = np.repeat(lo, counts), np.repeat(hi, counts)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[:, 0].copy(), rows[:, 1].copy(), rows[:, 2] - hi + 1, rows[:, 2] - lo)], names=["k_id", "k_text", "first", "last"])

        for p, right, left, where in merge([decode(x) for x in blocks]):
            if p < gram and len(lefts) >= 20_000:
                yield from flush()
                for x in (lcps, rights, lefts, wheres):
                    x.clear()
            lcps.append(p if lefts else 0)
            rights.append(len(right))
            lefts.append(left)
            wheres.append(where)
        if lefts:
            yield from flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dest, blocks = None, []
        for b in batches:
            for d, block in zip(b.column("dest").to_pylist(), b.column("block"), strict=True):
                if d != dest and blocks:
                    yield from one(blocks)
                    blocks = []
                dest = d
                blocks.append(block.as_py())
        if blocks:
            yield from one(blocks)

    return run


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """k_id, k_text, spans: for each row key with repeated windows, array of (first, last) ranges of their starts, in bytes."""
    spark = docs.sparkSession
    keyed = docs.select("text", *row_key())
    found = keyed.mapInArrow(_emit_anchors(length, gram), "h long, known boolean, lead long, k_id long, k_text long, at long, left int, more int")
    twice = F.col("known") | (F.count("*").over(Window.partitionBy("h")) > 1)
    again = scratch(found.withColumn("twice", twice).where("twice").select("k_id", "k_text", "lead", "at", "left", "more"), "suffix-anchors")
    # As many ranges as the rows ask for: about _RANGE suffixes each.
    ranges = max(1, partitions(spark), again.count() // _RANGE)
    points = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(again.agg(F.percentile_approx("lead", points, 20 * ranges).alias("cuts")).first()["cuts"] or [])) if points else []
    own = again.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("at", "left", "more")).alias("where"))
    blocks = keyed.join(own, ["k_id", "k_text"]).mapInArrow(_emit_runs(length, cuts), "dest int, block binary")
    spans = blocks.repartition(len(cuts) + 1, "dest").sortWithinPartitions("dest").mapInArrow(_emit_repeats(length, gram), "k_id long, k_text long, first long, last long")
    return spans.groupBy("k_id", "k_text").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))


def covered(spans: list[dict] | None, length: int = LENGTH) -> list[tuple[int, int]]:
    """Merged byte ranges under windows that start in the (first, last) ranges; spans come sorted."""
    out: list[list[int]] = []
    for s in spans or ():
        lo, hi = s["first"], s["last"] + length
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256.

    Null texts are empty. A text under `length` bytes loses nothing. A row that stands twice in the table repeats
    itself, so both lose all. kept may not be valid UTF-8 where a span ends inside a character.
    """
    spans = repeats(docs, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for value, spans in zip(b.column("text"), b.column("spans"), strict=True):
                data = (value.as_py() or "").encode()
                cut = covered(spans.as_py(), length)
                kept, at = [], 0
                for lo, hi in cut:
                    kept.append(data[at:lo])
                    at = hi
                kept = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(kept), len(cut), kept, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
            )

    keyed = docs.select("doc_id", "text", *row_key())
    joined = keyed.join(spans, ["k_id", "k_text"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x, encode(coalesce(text, '')) AS y FROM documents),
w AS (SELECT r, unnest(range(0, len(x) // 2 - 199)) AS i, y FROM d WHERE len(x) >= 400),
h AS (SELECT r, i, md5_number(array_slice(y, i + 1, i + 200)) AS h FROM w),
a AS (SELECT r, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
b AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM a),
c AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM b),
s AS (SELECT r, k, min(i) AS lo, max(i) + 200 AS hi FROM c GROUP BY ALL),
g AS (SELECT s.*, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS prev FROM s),
t AS (SELECT r, sum(hi - lo) AS gone, count(*) AS n, string_agg(substr(x, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) AS kept, max(hi) AS tail FROM g JOIN d USING (r) GROUP BY 1)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
