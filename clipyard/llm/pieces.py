"""Operator 5. SentencePiece encoding and decoding of a BPE vocabulary, by suffix-array matching.

A text becomes `▁` + text with spaces as `▁`, and is cut into units where no piece can reach across: before `▁`, before
characters that in all pieces only their like or `▁` precede (most punctuation), and after characters without a piece.
The text of a batch, as far as its units differ, is concatenated and indexed by a suffix array (as deep
as the longest piece); each piece is found by binary search as a range of it; the ranges give edges (start, piece),
sorted by offset in their unit. Then the edges are relaxed in that order: an edge holds after the piece that ends where
it starts if the merges leave the two side by side, which a pair shows by itself. So at most one piece holds at each
place, and the path to the end is the encoding that the merges would make. A character without a piece becomes its
bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipyard.llm.common import table, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SLICE_CHARS, BATCH_ROWS, BATCH_CHARS, PAIRS = 100_000, 250, 500_000, 1 << 20
#: Stands for NUL inside units, which separates them. Texts hold no lone surrogate.
NUL = "\udc00"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id (None where an id is not text), their scores, and the id of byte 0; bytes follow in order."""

    pieces: tuple[str | None, ...]
    scores: tuple[float, ...]
    byte0: int


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
    return Vocabulary(tuple(None if special[i] else sp.id_to_piece(i) for i in range(n)), tuple(sp.get_score(i) for i in range(n)), next(i for i in range(n) if sp.is_byte(i)))


class Encoder:
    """Encodes texts to ids (uint16 arrays) and back; keeps what it learned of pairs of pieces, within bounds."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.id_of = {p: i for i, p in enumerate(vocabulary.pieces) if p}
        n = len(vocabulary.pieces)
        self.length = np.array([len(p) if p else 0 for p in vocabulary.pieces])
        self.depth = int(self.length.max())
        # Order in which merges make the pieces; 0 for single characters, which no merge makes.
        by_score = sorted((i for i in self.id_of.values() if self.length[i] > 1), key=lambda i: (-vocabulary.scores[i], i))
        self.rank, tie, last = np.zeros(n, np.int64), 0, None
        for i in by_score:
            tie, last = tie + (vocabulary.scores[i] != last), vocabulary.scores[i]
            self.rank[i] = tie
        # The halves of each piece's last merge; a piece that its own merges don't make is never used.
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        usable, keys, ranks = [], [], []
        for p, i in self.id_of.items():
            for cut in range(1, len(p)):
                x, y = self.id_of.get(p[:cut]), self.id_of.get(p[cut:])
                if x is not None and y is not None:
                    keys.append(x << 16 | y)
                    ranks.append(self.rank[i])
            trace: list[tuple[str, str]] = []
            if self.symbols(p, trace) == [p]:
                usable.append(i)
                if trace:
                    self.left[i], self.right[i] = self.id_of[trace[-1][0]], self.id_of[trace[-1][1]]
        order = np.argsort(keys)
        self.joint, self.joint_rank = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.usable = np.array(sorted(usable, key=lambda i: vocabulary.pieces[i]), np.int64)
        self.sought = np.array([[ord(ch) for ch in vocabulary.pieces[i].ljust(self.depth, "\0")] for i in self.usable], np.int64).reshape(-1, self.depth)
        self.raw = [p.replace(SPACE, " ").encode() if p else b"" for p in vocabulary.pieces]
        for b in range(256):
            self.raw[vocabulary.byte0 + b] = bytes([b])
        self.unit = self._cuts()
        self.pair_key, self.pair_ok = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)

    def _cuts(self) -> re.Pattern:
        """Finds the units: K are the characters before which a unit may end, U those of K without a piece."""
        before: dict[str, set[str]] = {}
        for p in self.id_of:
            for a, b in zip(p, p[1:]):
                before.setdefault(b, set()).add(a)
        single = {p for p in self.id_of if len(p) == 1}
        k = {chr(i) for i in range(128) if not chr(i).isalnum()}
        while bad := {c for c in k if before.get(c, set()) - k - {SPACE}}:
            k -= bad
        u = {c for c in k if c not in single and c not in before}
        k_, u_ = ("".join(map(re.escape, sorted(x))) for x in (k, u))
        cut_u = rf"{SPACE}*[{k_}]*[{u_}]|" if u else ""
        return re.compile(rf"{SPACE}*[^{SPACE}{k_}]+|{cut_u}{SPACE}*[{k_}]+[^{SPACE}{k_}]*|{SPACE}+")

    # merges -------------------------------------------------------------------------------------

    def symbols(self, text: str, trace: list | None = None) -> list[str]:
        """What the merges make of a text: best score first, then leftmost. trace takes the pairs merged."""
        symbols: list[str | None] = list(text)
        after, before = [*range(1, len(symbols)), -1], [-1, *range(len(symbols) - 1)]
        queue: list[tuple[int, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (whole := self.id_of.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(queue, (int(self.rank[whole]), i, j, symbols[i] + symbols[j]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, whole = heapq.heappop(queue)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != whole:
                continue
            if trace is not None:
                trace.append((symbols[i], symbols[j]))
            symbols[i], symbols[j] = whole, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s is not None]

    def _check(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merges leave a and b side by side: the merges that made them are taken back, latest first, and none across the seam may have come earlier than what was taken back."""
        x, y, ok = a.copy(), b.copy(), np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        rows = np.arange(len(a))
        while len(rows):
            key = x[rows] << 16 | y[rows]
            at = np.minimum(np.searchsorted(self.joint, key), len(self.joint) - 1)
            bad = (self.joint[at] == key) & (self.joint_rank[at] < limit[rows])
            ok[rows[bad]] = False
            rows = rows[~bad]
            rx, ry = self.rank[x[rows]], self.rank[y[rows]]
            rows, rx, ry = (v[(rx > 0) | (ry > 0)] for v in (rows, rx, ry))
            back_x = rx > ry
            limit[rows] = np.where(back_x, rx, ry + 1)  # of equal merges the left one came first
            x[rows] = np.where(back_x, self.right[x[rows]], x[rows])
            y[rows] = np.where(back_x, y[rows], self.left[y[rows]])
        return ok

    def _beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_check, over a table of pairs met before (one place for each hash)."""
        key = a << 16 | b
        slot = ((key * 0x9E3779B1) >> 8) & (PAIRS - 1)
        new = np.flatnonzero(self.pair_key[slot] != key)
        if not len(new):
            return self.pair_ok[slot]
        known, which = np.unique(key[new], return_inverse=True)
        ok = self._check(known >> 16, known & 0xFFFF)
        out = self.pair_ok[slot]
        out[new] = ok[which]
        slot = ((known * 0x9E3779B1) >> 8) & (PAIRS - 1)
        self.pair_key[slot], self.pair_ok[slot] = known, ok
        # Where two new pairs share a place, the later stands; its answer must be its own.
        self.pair_ok[slot] = np.where(self.pair_key[slot] == known, ok, self.pair_ok[slot])
        return out

    # suffix array and edges ---------------------------------------------------------------------

    def _edges(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and piece of every occurrence of a piece in t (code points, ended by `depth` zeros), by position, longer first."""
        n = len(t) - self.depth
        present = np.zeros(int(t.max(initial=0)) + 1, bool)
        present[t] = True
        symbols = np.flatnonzero(present)
        bits = max(8, int(len(symbols)).bit_length())
        each = 63 // bits
        number = np.cumsum(present) - 1
        code = np.concatenate([number[t], np.zeros(each, np.int64)])
        # Pieces all of whose characters occur, as numbers of the characters.
        inside = np.minimum(self.sought, len(present) - 1)
        rows = np.flatnonzero((present[inside] & (inside == self.sought) | (self.sought == 0)).all(axis=1))
        sought = np.where(self.sought[rows] > 0, number[inside[rows]], 0)
        sought = np.concatenate([sought, np.zeros((len(rows), each), np.int64)], axis=1)
        ids = self.usable[rows]
        length = self.length[ids]
        keys = []
        for at in range(0, self.depth, each):
            out = np.zeros(n, np.int64)
            for i in range(at, at + each):
                out = out << bits | (code[i : i + n] if i < self.depth else 0)
            keys.append(out)
        # Suffixes by their first `each` characters; ranges that a longer piece needs are sorted further where it is sought.
        suffixes = np.argsort(keys[0])
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), n, np.int64)
        for g, key in enumerate(keys):
            at = g * each
            use = np.flatnonzero((length > at) & (hi > lo))
            least = np.zeros(len(use), np.int64)
            for i in range(at, at + each):
                least = least << bits | sought[use, i]
            rest = np.maximum(0, each - (length[use] - at)) * bits
            most = least | ((np.int64(1) << rest) - 1)
            if g == 0:
                ordered = key[suffixes]
                lo[use], hi[use] = np.searchsorted(ordered, least), np.searchsorted(ordered, most, side="right")
                continue
            for r, x, y in zip(use.tolist(), least.tolist(), most.tolist(), strict=True):
                base, end = int(lo[r]), int(hi[r])
                part = suffixes[base:end]
                own = key[part]
                if (own[1:] < own[:-1]).any():
                    order = np.argsort(own)
                    suffixes[base:end], own = part[order], own[order]
                lo[r], hi[r] = base + np.searchsorted(own, x), base + np.searchsorted(own, y, side="right")
        count = hi - lo
        at = suffixes[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        return at, np.repeat(ids, count)

    def _relax(self, units: list[str]) -> list[bytes]:
        """The encodings of units. All are relaxed in step: at offset j of each, every edge that starts there is held against the one piece that ends there."""
        text = "\0".join(units) + "\0" * (self.depth + 1)
        t = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(u) for u in units])
        base = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        at, piece = self._edges(t)
        offset = (np.arange(len(t)) - np.repeat(np.append(base, len(t) - self.depth), np.append(size + 1, self.depth)))[at]
        order = np.argsort(offset, kind="stable")
        at, piece, offset = at[order], piece[order], offset[order]
        to = at + self.length[piece]
        # last[i]: the piece that ends at i; -1 where none can merge with what follows, -2 where none is known yet.
        last = np.full(len(t) + 1, -2, np.int64)
        known = np.zeros(len(t), bool)
        known[at[self.length[piece] == 1]] = True
        last[np.flatnonzero(~known) + 1] = -1
        last[base] = -1
        bounds = np.searchsorted(offset, np.arange(int(offset.max(initial=-1)) + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            before = last[at[lo:hi]]
            ok = before == -1
            test = np.flatnonzero(before >= 0)
            ok[test] = self._beside(before[test], piece[lo:hi][test])
            last[to[lo:hi][ok]] = piece[lo:hi][ok]
        # From each unit's end back to its start.
        live, where, steps = np.arange(len(units)), base + size, []
        while len(live):
            p = last[where[live]]
            steps.append((live, np.where(p >= 0, p, -t[where[live] - 1] - 1)))
            where[live] -= np.where(p >= 0, self.length[p], 1)
            live = live[where[live] > base[live]]
        unit = np.concatenate([s[0] for s in steps])
        ids = np.concatenate([s[1] for s in steps])
        order = np.lexsort((-np.arange(len(unit)), unit))
        unit, ids = unit[order], ids[order]
        ends = np.searchsorted(unit, np.arange(len(units) + 1)).tolist()
        flat = ids.astype("<u2").tobytes()
        out = [flat[2 * lo : 2 * hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
        for i in np.unique(unit[ids < 0]).tolist():
            out[i] = self._bytes(ids[ends[i] : ends[i + 1]].tolist())
        return out

    def _bytes(self, ids: list[int]) -> bytes:
        """Ids as 16 bits, with -1 - code point for a character that becomes its bytes."""
        full = [i for x in ids for i in ([x] if x >= 0 else [self.v.byte0 + b for b in chr(-x - 1).replace(NUL, "\0").encode()])]
        return np.array(full, "<u2").tobytes()

    # texts --------------------------------------------------------------------------------------

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """The encodings of units, relaxed in slices of about SLICE_CHARS characters."""
        out, part, size = {}, [], 0
        for k, u in enumerate(units, 1):
            part.append(u)
            size += len(u) + 1
            if size >= SLICE_CHARS or k == len(units):
                out.update(zip(part, self._relax([x.replace("\0", NUL) for x in part]), strict=True))
                part, size = [], 0
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        known = self._learn(list({u for own in split for u in own}))
        return [np.frombuffer(b"".join(map(known.__getitem__, own)), "<u2") for own in split]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode(errors="replace").removeprefix(" ")


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder; tasks that follow one another in a worker share it."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column in order, null as empty, with the row of the first: at most BATCH_ROWS, and no more after BATCH_CHARS characters."""
    first, part, size = 0, [], 0
    for i, value in enumerate(column):
        part.append(value.as_py() or "")
        size += len(part[-1])
        if len(part) == BATCH_ROWS or size >= BATCH_CHARS:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


def encode(docs: DataFrame, model_path: str = MODEL, check: bool = True) -> DataFrame:
    """doc_id, ids (array of int), round_trip of each row of docs. round_trip: decoding gives the text again, with `▁` read as a space; null unless `check`.

    A null or empty text has no ids. Rows are independent, so ties and repeated rows need no rule.
    """
    held = docs.sparkSession.sparkContext.broadcast(load(model_path))  # the vocabulary's size, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value)
        for b in batches:
            for lo, texts in _parts(b.column("text")):
                ids = encoder.encode(texts)
                same = [encoder.decode(i) == t.replace(SPACE, " ") if check else None for i, t in zip(ids, texts, strict=True)]
                flat = np.concatenate([np.zeros(0, np.int32), *(i.astype(np.int32) for i in ids)])
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo : lo + len(texts)], pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(same, pa.bool_())], names=["doc_id", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""
    held = encoded.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if i is None else encoder.decode(np.array(i, np.int64)) for i in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def digest(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 16 bits), text_sha256 of the decoded text, round_trip."""
    held = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value)
        for b in batches:
            for lo, texts in _parts(b.column("text")):
                rows = []
                for i, t in zip(encoder.encode(texts), texts, strict=True):
                    again = encoder.decode(i)
                    rows.append((len(i), hashlib.sha256(i.tobytes()).hexdigest(), hashlib.sha256(again.encode()).hexdigest(), again == t.replace(SPACE, " ")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo : lo + len(texts)], *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.bool_())))], names=["doc_id", "n_tokens", "ids_sha256", "text_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, text_sha256 string, round_trip boolean")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
