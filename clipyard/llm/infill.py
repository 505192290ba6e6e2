"""Operator 12. Fill-in-middle transformation with content-defined chunk memoization.

A unit is a run of A-Z and a-z, or any other single code point. A rolling (gear) hash over the last 32 bytes cuts each
text into chunks at places that its content defines, so copied passages give the same chunks wherever they stand. A
chunk is looked up by its content (hashed, then compared byte by byte) in a cache of boundary summaries: how many units
begin in it, how many code points it has, whether it begins and ends with a letter. The units of a text are the sums
over its chunks, less one for each border between two letters; running sums find the chunk of a cut, and only that chunk
is looked into for the place itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipyard.llm.common import mix, table, tidy

MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
#: Bytes of the hash's window, bits of it that are zero at a cut (256 bytes a chunk on average), longest chunk.
WINDOW, CUT_BITS, LONGEST = 32, 8, 4096
#: Bytes of text worked on at once, and bytes of chunks that a task's cache holds before it starts anew.
BATCH_BYTES, CACHE_BYTES = 4_000_000, 16_000_000

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_FIRST = np.ones(256, bool)  # bytes that begin a code point
_FIRST[0x80:0xC0] = False


def starts(data: np.ndarray, after_letter: bool = False) -> np.ndarray:
    """Offsets in UTF-8 bytes where a unit begins; after_letter: the byte before data is a letter."""
    letter = _LETTER[data]
    before = np.concatenate([[after_letter], letter[:-1]])
    return np.flatnonzero(np.where(letter, ~before, _FIRST[data]))


def chunk_ends(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of the chunks of texts that lie one after another in data, text k at bounds[k]:bounds[k + 1]. A text's end is a chunk's end; no chunk is over LONGEST; an empty text has none."""
    roll = _GEAR[data]
    step = 1
    while step < WINDOW:  # sum of gear[byte] << distance over the window, doubled until it is wide enough
        wider = roll.copy()
        wider[step:] += roll[:-step] << np.uint32(step)
        roll, step = wider, 2 * step
    cut = np.flatnonzero(roll >> np.uint32(32 - CUT_BITS) == 0) + 1
    into = cut - bounds[np.searchsorted(bounds, cut, side="left") - 1]
    ends = np.unique(np.concatenate([cut[into >= WINDOW], bounds[1:]]))  # a window that reaches into the text before it decides nothing
    ends = ends[ends > 0]
    size = np.diff(ends, prepend=0)
    more = np.maximum(0, (size - 1) // LONGEST)  # further cuts in long chunks
    if more.any():
        at = np.repeat(ends - size, more) + LONGEST * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
        ends = np.unique(np.concatenate([ends, at]))
    return ends


class Summaries:
    """Boundary summaries of chunks by content: rows of (units, code points, begins with a letter, ends with one)."""

    def __init__(self):
        self.row: dict[bytes, int] = {}
        self.rows = np.zeros((0, 4), np.int64)
        self.held = 0

    def of(self, chunks: list[bytes]) -> np.ndarray:
        """The summaries of chunks; those not in the cache are counted together."""
        if self.held > CACHE_BYTES:
            self.__init__()
        new = list({c: None for c in chunks if c not in self.row})
        if new:
            self.row.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            size = np.array([len(c) for c in new])
            data = np.frombuffer(b"".join(new), np.uint8)
            at = np.cumsum(size) - size
            letter, first = _LETTER[data], _FIRST[data]
            before = np.concatenate([[False], letter[:-1]])
            before[at] = False
            begins = np.where(letter, ~before, first)
            own = np.stack([np.add.reduceat(begins, at, dtype=np.int64), np.add.reduceat(first, at, dtype=np.int64), letter[at], letter[at + size - 1]], axis=1)
            self.rows = np.concatenate([self.rows, own])
            self.held += int(size.sum())
        return self.rows[[self.row[c] for c in chunks]]


class Texts:
    """Units of some texts, by running sums over their chunks."""

    def __init__(self, raw: list[bytes], cache: Summaries):
        self.raw = b"".join(raw)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        data = np.frombuffer(self.raw, np.uint8)
        self.ends = chunk_ends(data, self.bounds) if len(data) else np.zeros(0, np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)[: len(self.ends)]
        s = cache.of([self.raw[a:b] for a, b in zip(self.begins.tolist(), self.ends.tolist(), strict=True)]).reshape(-1, 4)
        inner = ~np.isin(self.begins, self.bounds)
        self.joined = inner & (s[:, 2] == 1) & (np.concatenate([[0], s[:, 3]])[: len(s)] == 1)
        self.units = np.concatenate([[0], np.cumsum(s[:, 0] - self.joined)]).astype(np.int64)
        self.chars = np.concatenate([[0], np.cumsum(s[:, 1])]).astype(np.int64)
        self.chunk = np.searchsorted(self.ends, self.bounds, side="left") + (self.bounds > 0)  # chunks before each bound
        self.chunk = np.where(self.bounds == 0, 0, self.chunk)

    def count(self, k: int) -> int:
        return int(self.units[self.chunk[k + 1]] - self.units[self.chunk[k]])

    def cut(self, k: int, after: int) -> tuple[int, int]:
        """(byte, code point) of text k behind its first `after` units."""
        lo, hi = self.chunk[k], self.chunk[k + 1]
        if after >= self.units[hi] - self.units[lo]:
            return int(self.bounds[k + 1] - self.bounds[k]), int(self.chars[hi] - self.chars[lo])
        unit = self.units[lo] + after
        c = int(np.searchsorted(self.units, unit, side="right")) - 1
        own = np.frombuffer(self.raw, np.uint8)[self.begins[c] : self.ends[c]]
        place = int(starts(own, bool(self.joined[c]))[unit - self.units[c]])
        return int(self.begins[c] - self.bounds[k]) + place, int(self.chars[c] - self.chars[lo]) + int(_FIRST[own[:place]].sum())


def _draws(seed: int, doc_id: int | None) -> list[int]:
    """h1 to h4: groups of eight digits of the sha256 of seed:doc_id; of seed: where the id is null."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of each row of docs.

    Two cuts, drawn from seed and doc_id, part the text in prefix, middle and suffix. `rate` of a hundred documents are
    rearranged, `spm_rate` of a hundred of those with the suffix first. A null text is empty; an empty text, and one
    that holds a mark, stays as it is (plain). Rows with a null doc_id share one draw; repeated rows give the same rows.
    """
    p, s, m = (MARKS[x].encode() for x in ("prefix", "suffix", "middle"))

    def rows(ids: list, raw: list[bytes], cache: Summaries) -> Iterator[tuple]:
        texts = Texts(raw, cache)
        for k, (doc_id, t) in enumerate(zip(ids, raw, strict=True)):
            n, (h1, h2, h3, h4) = texts.count(k), _draws(seed, doc_id)
            if not t or p in t or s in t or m in t or h3 % 100 >= rate:
                yield doc_id, n, "plain", None, None, t.decode()
                continue
            (a, a_chars), (b, b_chars) = (texts.cut(k, i) for i in sorted((h1 % (n + 1), h2 % (n + 1))))
            spm = h4 % 100 < spm_rate
            out = b"".join((s, t[b:], p, t[:a], m, t[a:b]) if spm else (p, t[:a], s, t[b:], m, t[a:b]))
            yield doc_id, n, "spm" if spm else "psm", a_chars, b_chars - a_chars, out.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Summaries()
        for batch in batches:
            ids, raw, size = [], [], 0
            for i, value in enumerate(batch.column("text"), 1):
                ids.append(batch.column("doc_id")[i - 1].as_py())
                raw.append((value.as_py() or "").encode())
                size += len(raw[-1])
                if size >= BATCH_BYTES or i == batch.num_rows:
                    got = list(zip(*rows(ids, raw, cache), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    ids, raw, size = [], [], 0

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that was rearranged. Marks are three different characters of which none begins inside another, so a text without marks gives none across a border either."""
    part = F.split(output, "|".join(MARKS.values()), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
