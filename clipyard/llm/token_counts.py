"""Operator 11. Token counts by prefix dynamic programming, for a byte-level BPE vocabulary of the tokenizers library.

For each prefix of a pre-token there is exactly one token that its encoding ends with: the one that ends there and that
the merges leave side by side with the last token of the prefix before it. So going from left to right,
count[i] = count[i - length of that token] + 1 gives the exact number of tokens of every prefix. The different
pre-tokens of a batch go through this in step. The counts of a text's prefixes are those of its pre-tokens upon the
sums before them, with three rules where a text that ends early is cut in other pre-tokens than
the whole: in white space before a word, in a contraction, and in the text of an added token.

The table answers questions of budget (tokens of the first n characters) and truncation (the longest prefix within a
budget) without encoding again.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipyard.llm.common import mix, table, tidy

TOKENIZER, LIMIT = "byte_bpe_50k.json", 512
BATCH_ROWS, BATCH_CHARS = 1000, 4_000_000
#: Bounds of what a worker keeps: bits of the number of answers about pairs of tokens, and tables of pieces of at most PIECE_CHARS characters.
PAIR_BITS, PIECES, PIECE_CHARS = 19, 250_000, 32
#: Pre-tokens of up to LONG bytes are gone through in step, at most WORDS at once.
LONG, WORDS = 64, 32_768
ABSENT = -2
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Vocabulary:
    """Tokens as bytes with their ids, pairs of ids with (order, id) of their merge, added tokens, and ranges of letters, numbers and white space as the library knows them."""

    tokens: dict[bytes, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    added: tuple[str, ...]
    letters: str
    numbers: str
    spaces: str


def _byte_of() -> dict[str, int]:
    """The byte that each character of a vocabulary file stands for: printable Latin-1 for itself, the others in turn from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _classes(tokenizer) -> tuple[str, str, str]:
    """Ranges, for a regular expression, of what the library takes for letters, numbers and white space: runs of Python's own categories, each asked of the library and halved where it disagrees."""
    beside = {"L": "a", "N": "1", "S": "\n", "O": "!"}
    whole = lambda s: len(tokenizer.pre_tokenizer.pre_tokenize_str(s)) == 1
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in beside}

    def put(lo: int, hi: int, guess: str) -> None:
        text = "".join(map(chr, range(lo, hi)))
        kind = next((k for k in (guess, *beside) if whole(beside[k] + text)), None)
        if kind:
            out[kind].append((lo, hi - 1))
        else:
            put(lo, (lo + hi) // 2, guess)
            put((lo + hi) // 2, hi, guess)

    def guess(c: int) -> str:
        kind = unicodedata.category(chr(c))[0]
        return kind if kind in "LN" else "S" if chr(c).isspace() else "O"

    for kind, run in groupby((c for c in range(0x110000) if not 0xD800 <= c < 0xE000), lambda c: (guess(c), c >= 0xE000)):
        run = list(run)
        put(run[0], run[-1] + 1, kind[0])
    return tuple("".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out[k]) for k in "LNS")


@cache
def load(path: str | None = None) -> Vocabulary:
    """The vocabulary of a tokenizer file with byte-level BPE, no normaliser and plain added tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    pre, added = held["pre_tokenizer"], held["added_tokens"]
    if held["model"]["type"] != "BPE" or held["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError(f"{path} is not plain byte-level BPE")
    of = _byte_of()
    raw = lambda token: bytes(map(of.__getitem__, token))
    plain = {t["content"] for t in added}
    ids = {raw(t): i for t, i in held["model"]["vocab"].items() if t not in plain}
    merges = {}
    for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]):
        merges.setdefault((ids[raw(a)], ids[raw(b)]), (rank, ids[raw(a) + raw(b)]))
    return Vocabulary(ids, merges, tuple(sorted(plain, key=len, reverse=True)), *_classes(Tokenizer.from_file(path)))


class Ends:
    """Ends of tokens by a hash of their bytes, so that a search from a place to the left knows when to stop: the token's id where an end is a token, else -1. A token found so is compared byte by byte."""

    def __init__(self, tokens: dict[bytes, int]):
        words = list(tokens)
        data, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
        end = np.cumsum(size) - 1
        self.depth = int(size.max())
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.depth - 1, _BASE)]), dtype=np.uint64)
        key, keys, values = np.zeros(len(words), np.uint64), [], []
        ids = np.array([tokens[w] for w in words])
        for n in range(1, self.depth + 1):
            live = np.flatnonzero(size >= n)
            key[live] += self.term(data[end[live] - n + 1], n)
            keys.append(key[live].copy())
            values.append(np.where(size[live] == n, ids[live], -1))
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.lexsort((-values, keys))
        keys, values = keys[order], values[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        keys, values = keys[first], values[first]
        self.bits = int(4 * len(keys)).bit_length()
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, ABSENT)
        slot = self._slot(keys)
        while len(keys):  # each key takes its slot, or the next one that is free
            free = np.flatnonzero(self.values[slot] == ABSENT)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            keys, values, slot = (np.delete(x, put) for x in (keys, values, slot))
            slot = (slot + 1) & ((1 << self.bits) - 1)
        self.tail = np.zeros(int(ids.max()) + 1, np.uint64)
        self.tail[ids] = [int.from_bytes(w[-8:], "big") for w in words]

    def term(self, byte: np.ndarray, n: int) -> np.ndarray:
        """What the n-th byte from the end adds to the hash."""
        return (byte.astype(np.uint64) + np.uint64(1)) * self.power[n - 1]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        value, wrong = self.values[slot], np.flatnonzero(self.keys[slot] != keys)
        while len(wrong := wrong[value[wrong] != ABSENT]):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            value[wrong] = self.values[slot[wrong]]
            wrong = wrong[self.keys[slot[wrong]] != keys[wrong]]
        return value


class Counter:
    """Counts of tokens of every prefix of texts."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.raw = {i: t for t, i in v.tokens.items()}
        self.ends = Ends(v.tokens)
        self.size = max(v.tokens.values()) + 2
        self.halves: dict[int, tuple[int, int, int] | None] = {}
        self.pair_key, self.pair_ok = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        letters, numbers, spaces = v.letters, v.numbers, v.spaces
        body = f"[{letters}]+|[{numbers}]+|[^{spaces}{letters}{numbers}]+"
        # A unit is white space with the word behind it: the counts of its prefixes depend on nothing before it.
        self.unit = re.compile(f"((?:[{spaces}]*(?! )[{spaces}])?)('(?:s|t|re|ve|m|ll|d))|([{spaces}]*)({body})|([{spaces}]+)")
        # Pieces of a text that end where a unit does, found without the large classes.
        self.piece = re.compile(r"\s*\S+|\s+")
        # Most pieces: a word of Latin letters after one space or none, and one mark or none behind it.
        self.simple = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")
        self.known: dict[str, bytes] = {}
        self.added = re.compile("|".join(map(re.escape, v.added))) if v.added else None

    @cached_property
    def suffixes(self) -> dict[bytes, int]:
        """The ends of tokens as a dictionary, for long pre-tokens."""
        out: dict[bytes, int] = {}
        for t in self.v.tokens:
            for i in range(len(t)):
                out.setdefault(t[i:], self.v.tokens.get(t[i:], -1))
        return out

    def made(self, token: int) -> tuple[int, int, int] | None:
        """(order of the last merge, left half, right half) as the merges make a token of its bytes, earliest merge first, then leftmost; order -1 for a byte, None if they make something else of them."""
        if token not in self.halves:
            raw = self.raw[token]
            ids, half = [self.v.tokens[raw[i : i + 1]] for i in range(len(raw))], (-1, -1, -1)
            while len(ids) > 1:
                rank, new, i = min((*self.v.merges.get(pair, (len(self.v.merges), -1)), i) for i, pair in enumerate(zip(ids, ids[1:])))
                if new < 0:
                    break
                half = (rank, ids[i], ids[i + 1])
                ids = [*ids[:i], new, *ids[i + 2 :]]
            self.halves[token] = half if ids == [token] else None
        return self.halves[token]

    def beside(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b side by side (a = -1: whether they make b alone of its bytes).

        They do unless a pair across the border merges before one of its sides has grown further. So the later merge of
        the two is undone, again and again, and each pair that then meets at the border is looked up. At equal order the
        left one merges first.
        """
        if self.made(b) is None or a >= 0 and self.made(a) is None:
            return False
        before = len(self.v.merges) + 1
        while a >= 0:
            if self.v.merges.get((a, b), (before,))[0] < before:
                return False
            (left, _, a_half), (right, b_half, _) = self.made(a), self.made(b)
            if left < 0 > right:
                return True
            if left > right:
                a, before = a_half, left
            else:
                b, before = b_half, right + 1
        return True

    def prefixes(self, words: set[bytes]) -> dict[bytes, bytes]:
        """For each pre-token, the tokens of its first 1, 2, ... bytes, as 32-bit numbers."""
        out = {w: self._of_long(w) for w in words if len(w) > LONG}
        short = sorted((w for w in words if len(w) <= LONG), key=len, reverse=True)
        for lo in range(0, len(short), WORDS):
            out.update(self._of_short(short[lo : lo + WORDS]))
        return out

    def _of_short(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Many pre-tokens in step, longest first: at each length of prefix, the longest token is tried first in all of them."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        start = np.cumsum(size) - size
        into = np.arange(len(data)) - np.repeat(start, size) + 1
        ending = self._ending(data, into)
        held = start + np.arange(len(words))  # the place of each word's empty prefix
        last, count = np.full(len(data) + len(words), -1, np.int64), np.zeros(len(data) + len(words), np.int32)
        for i in range(1, int(size[0]) + 1):
            left = np.arange(np.searchsorted(-size, -i, side="right"))
            for n in range(min(i, len(ending)), 0, -1):
                token = ending[n - 1][start[left] + i - 1]
                has = np.flatnonzero(token >= 0)
                if not len(has):
                    continue
                token, before = token[has], held[left[has]] + i - n
                if n > 1:
                    ok = self._beside(last[before], token)
                    has, token, before = has[ok], token[ok], before[ok]
                last[before + n], count[before + n] = token, count[before] + 1
                left = np.delete(left, has)
        flat = count.tobytes()
        return ((w, flat[4 * (p + 1) : 4 * (p + 1 + len(w))]) for w, p in zip(words, held.tolist(), strict=True))

    def _ending(self, data: np.ndarray, into: np.ndarray) -> list[np.ndarray]:
        """For lengths 1, 2, ...: the token of that length that ends with each byte, -1 where there is none. into: bytes of the word up to there."""
        out, live, key = [], np.arange(len(data)), np.zeros(len(data), np.uint64)
        tail = np.zeros(len(data), np.uint64)  # the last eight bytes
        for k in range(min(8, len(data))):
            tail[k:] |= data[: len(data) - k].astype(np.uint64) << np.uint64(8 * k)
        raw = data.tobytes()
        for n in range(1, self.ends.depth + 1):
            live = live[into[live] >= n]
            key[live] += self.ends.term(data[live - n + 1], n)
            value = self.ends.get(key[live])
            live, value = live[value != ABSENT], value[value != ABSENT]
            if not len(live):
                break
            at, token = live[value >= 0], value[value >= 0]
            if n <= 8:
                same = (tail[at] ^ self.ends.tail[token]) & np.uint64((1 << 8 * n) - 1) == 0
            else:
                same = np.array([raw[e - n + 1 : e + 1] == self.raw[t] for e, t in zip(at.tolist(), token.tolist(), strict=True)], bool)
            own = np.full(len(data), -1, np.int64)
            own[at[same]] = token[same]
            out.append(own)
        return out

    def _beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """beside() of many pairs; answers stay in a table where newer ones take the place of older ones."""
        key = (a + 1) * self.size + b
        slot = (mix(key) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        ok = self.pair_ok[slot]
        missed = np.flatnonzero(self.pair_key[slot] != key)
        if len(missed):
            new, back = np.unique(key[missed], return_inverse=True)
            found = np.array([self.beside(k // self.size - 1, k % self.size) for k in new.tolist()])
            ok[missed] = found[back]
            self.pair_key[slot[missed]], self.pair_ok[slot[missed]] = key[missed], ok[missed]
        return ok

    def _of_long(self, w: bytes) -> bytes:
        """One long pre-token, prefix after prefix."""
        last, count, known = [-1], array("i", [0]), self.suffixes
        for i in range(1, len(w) + 1):
            lo, found = i - 1, []
            token = known.get(w[lo:i])
            while token is not None:
                if token >= 0:
                    found.append((lo, token))
                if not lo:
                    break
                lo -= 1
                token = known.get(w[lo:i])
            while found:  # the longest first; the last is the single byte
                lo, token = found.pop()
                if not found or self._beside(np.array([last[lo]]), np.array([token]))[0]:
                    break
            last.append(token)
            count.append(count[lo] + 1)
        return count[1:].tobytes()

    def _new_tables(self, pieces: list[str]) -> dict[str, bytes]:
        """For each piece, the tokens of its first 1, 2, ... code points, as 32-bit numbers."""
        plain, cut, simple = [], {}, self.simple.fullmatch
        words: set[bytes] = set()
        for p in pieces:
            if m := simple(p):
                word, mark = m.groups()
                raw = word.encode()
                words.add(raw)
                plain.append((p, raw, len(word), mark))
                continue
            units = cut[p] = [(s + space, short, word, tail) for s, short, space, word, tail in self.unit.findall(p)]
            for space, short, word, tail in units:
                words.update(x.encode() for x in (space + tail, space[:-1], space[-1:].strip(" "), " " * (space[-1:] == " ") + short + word) if x)
        known = self.prefixes(words)

        def at_chars(raw: bytes, n: int) -> bytes:
            counts = known[raw]
            return counts if len(raw) == n else b"".join([counts[4 * i : 4 * i + 4] for i, following in enumerate(raw[1:] + b" ") if following & 0xC0 != 0x80])

        def numbers(raw: bytes, n: int) -> array:
            out = array("i")
            out.frombytes(at_chars(raw, n))
            return out

        out = {}
        for p, raw, n, mark in plain:
            counts = at_chars(raw, n)
            out[p] = counts + (int.from_bytes(counts[-4:], sys.byteorder) + 1).to_bytes(4, sys.byteorder) if mark else counts
        for p, units in cut.items():
            base, counts = 0, array("i")
            for space, short, word, tail in units:
                run = space + tail
                if run:  # a text that ends in white space has it as one pre-token
                    counts.extend([base + c for c in numbers(run.encode(), len(run))])
                if tail:
                    continue
                if len(space) > 1:
                    base += numbers(space[:-1].encode(), len(space) - 1)[-1]
                blank = space[-1:] == " "
                if space and not blank:
                    base += numbers(space[-1].encode(), 1)[-1]
                word = " " * blank + short + word
                own = numbers(word.encode(), len(word))
                if len(short) == 3:
                    own = [1, 2, own[2]]  # `'` and one letter of a longer contraction are two pre-tokens
                counts.extend([base + c for c in own[blank:]])
                base += own[-1]
            out[p] = counts.tobytes()
        return out

    def _tables(self, pieces: set[str]) -> dict[str, bytes]:
        """The tables of pieces; those met before come from a cache of bounded size."""
        out = {p: t for p in pieces if (t := self.known.get(p)) is not None}
        made = self._new_tables([p for p in pieces if p not in out])
        if len(self.known) + len(made) > PIECES:
            self.known = dict(out)
        if len(self.known) + len(made) <= PIECES:
            self.known.update((p, t) for p, t in made.items() if len(p) <= PIECE_CHARS)
        return out | made

    def _cut(self, text: str) -> list[str]:
        # What Python alone takes for white space could end a piece inside a unit.
        return [text] if any(c in text for c in "\x1c\x1d\x1e\x1f") else self.piece.findall(text)

    def tables(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the tokens of its first 1, 2, ... code points, each as if the text ended there."""
        jobs: list[list[tuple[list[str], list[str]]]] = []
        for text in texts:
            parts, lo = [], 0
            if self.added and any(a in text for a in self.v.added):
                for m in self.added.finditer(text):
                    parts.append((self._cut(text[lo : m.end()]), self._cut(text[lo : m.start()])))
                    lo = m.end()
            parts.append((self._cut(text[lo:]), []))
            jobs.append(parts)
        known = self._tables({p for parts in jobs for part in parts for own in part for p in own})

        def joined(pieces: list[str]) -> np.ndarray:
            flat = np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32)
            size = np.fromiter(map(len, pieces), np.int64, len(pieces))
            total = flat[np.cumsum(size) - 1] if len(pieces) else flat
            return flat + np.repeat(np.cumsum(total) - total, size).astype(np.int32)

        out = []
        for parts in jobs:
            base, own = 0, []
            for i, (pieces, before) in enumerate(parts):
                counts = joined(pieces) + np.int32(base)
                if i + 1 < len(parts):  # the added token is one token, once it is whole
                    plain = joined(before)
                    base += (int(plain[-1]) if len(plain) else 0) + 1
                    counts[-1] = base
                own.append(counts)
            out.append(own[0] if len(own) == 1 else np.concatenate(own))
        return out


_counters: dict[int, Counter] = {}


def _counter(v: Vocabulary) -> Counter:
    """The worker's counter; tasks that follow one another in a worker share it."""
    key = hash((len(v.tokens), len(v.merges), v.added, v.letters))
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(v)
    return _counters[key]


def _batches(held, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], list[np.ndarray]]]:
    """doc_id, texts (null as empty) and tables of at most BATCH_ROWS rows, and of no more after BATCH_CHARS characters."""
    counter = _counter(held.value)
    for b in batches:
        first, texts, size = 0, [], 0
        for i, value in enumerate(b.column("text"), 1):
            texts.append(value.as_py() or "")
            size += len(texts[-1])
            if len(texts) == BATCH_ROWS or size >= BATCH_CHARS or i == b.num_rows:
                yield b.column("doc_id")[first:i], texts, counter.tables(texts)
                first, texts, size = i, [], 0


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, counts of each row: counts[i] is the number of tokens of the text's first i + 1 code points.

    A null or empty text has no counts. Rows are independent, so ties and repeated rows need no rule; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(load(path))  # the vocabulary's size, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, tables in _batches(held, batches):
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tables])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tables)))], names=["doc_id", "counts"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, counts array<int>")


def tokens_of(counts: Column, n_chars: Column | int) -> Column:
    """Tokens of the first n_chars code points (of all, where the text has fewer)."""
    n = F.least(F.lit(n_chars) if isinstance(n_chars, int) else n_chars, F.size(counts)).cast("int")
    return F.when(n < 1, 0).otherwise(F.try_element_at(counts, F.greatest(n, F.lit(1))))


def longest_within(counts: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix of at most `budget` tokens. A longer prefix can have fewer tokens, so all are looked at."""
    most = F.lit(budget) if isinstance(budget, int) else budget
    return F.coalesce(F.array_max(F.transform(counts, lambda c, i: F.when(c <= most, i + 1))), F.lit(0))


def truncated(docs: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """doc_id, text (the longest prefix of at most `budget` tokens), n_tokens of it. Null texts stay null."""
    held = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, tables in _batches(held, batches):
            n = [_longest(t, budget) for t in tables]
            yield pa.RecordBatch.from_arrays([ids, pa.array([x[:k] for x, k in zip(texts, n, strict=True)], pa.string()), pa.array([int(t[k - 1]) if k else 0 for t, k in zip(tables, n, strict=True)], pa.int64())], names=["doc_id", "text", "n_tokens"])

    cut = docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, text string, n_tokens long")
    return cut.unionByName(docs.where(F.col("text").isNull()).select("doc_id", "text", F.lit(0).cast("long").alias("n_tokens")))


def _longest(counts: np.ndarray, budget: int) -> int:
    if not len(counts) or counts[-1] <= budget:
        return len(counts)
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def count_tokens(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, chars_within (code points of the longest prefix of at most `limit` tokens) of each row, all from the table of its prefixes.

    A null text is empty: no bytes, no tokens. Repeated rows give the same rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, tables in _batches(held, batches):
            n = [int(t[-1]) if len(t) else 0 for t in tables]
            columns = (([len(t.encode()) for t in texts], pa.int64()), (n, pa.int64()), ([k > limit for k in n], pa.bool_()), ([_longest(t, limit) for t in tables], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, kind) for c, kind in columns)], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_within long")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
