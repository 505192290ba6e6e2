"""Operator 1. Personal data: base spans, and terms that the corpus shows to disclose protected entities.

Protected entities are the values of base spans (an address, a number), identifiers (words of letters and digits that hold
`BITS` of information or more, as keys and tokens do), and each kind of them as a class of its own. How much a term t tells
of an entity c is their pointwise mutual information over the documents, PMI(c, t) = ln(n(c,t) N / (n(c) n(t))), held
against the information of the entity itself, IC(c) = ln(N / n(c)). Where PMI >= IC / alpha, and t stands beside c in at
least `support` different contexts, t discloses c: it is removed where PMI / IC >= `remove_at`, else generalised. Such
terms become `term` spans in every document that holds them. An identifier is a term that discloses itself, PMI = IC, and
becomes a `secret` span wherever it stands.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipyard.llm.common import row_key, scratch, table, tidy

KINDS = ("email", "ip", "card", "phone", "term", "secret")
TERM, SECRET = 4, 5
ALPHA, SUPPORT, WINDOW, REMOVE_AT, BITS = 1.25, 3, 6, 0.95, 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No match can begin inside a run of digits unless one begins before it, so the look-behind only spares retries.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]{3,}")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
_CODE = re.compile(r"[A-Za-z0-9]{12,}")
#: The same words for Spark.
_JAVA_WORD = r"[\p{L}\p{N}]{3,}"


def _luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, entity) of the base spans, by start, then kind."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end(), text[start : m.end()].lower()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = m[0].split(".")
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end(), m[0]))
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end(), d))
        if "+" in text:
            for m in _PHONE.finditer(text):
                d = _digits(m[0])
                if 9 <= len(d) <= 15:
                    out.append((m.start(), 3, m.end(), d))
    out.sort()
    return out


def identifiers(text: str, spans: list[tuple[int, int, int, str]], bits: float = BITS) -> list[tuple[int, int, int, str]]:
    """Words of ASCII letters and digits, both, outside the spans (sorted), whose length times the entropy of their characters is `bits` or more."""
    out = []
    for m in _CODE.finditer(text):
        if not (_DIGIT.search(m[0]) and _LETTER.search(m[0])):
            continue
        n = len(m[0])
        if sum(k * math.log2(n / k) for k in Counter(m[0]).values()) < bits:
            continue
        if not any(s[0] < m.end() and m.start() < s[2] for s in spans):
            out.append((m.start(), SECRET, m.end(), m[0]))
    return out


def contexts(text: str, spans: list[tuple[int, int, int, str]], window: int) -> list[tuple[str, str, str]]:
    """(entity, term, digest of the context): the nearest `window` words on either side of a span, those in spans left out, for its value and for its kind."""
    if not spans:
        return []
    taken, i, own = sorted((s[0], s[2]) for s in spans), 0, []
    for m in _WORD.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i == len(taken) or taken[i][0] >= m.end():
            own.append((m.start(), m[0].lower()))
    starts, words, out = [w[0] for w in own], [w[1] for w in own], []
    for start, kind, end, entity in spans:
        at, after = bisect_left(starts, start), bisect_left(starts, end)
        left, right = words[max(0, at - window) : at], words[after : after + window]
        mark = hashlib.md5(" ".join([*left, "|", *right]).encode()).hexdigest()[:16]
        out += [(e, t, mark) for t in {*left, *right} for e in (f"{KINDS[kind]}:{entity}", f"kind:{KINDS[kind]}")]
    return out


def detect_base(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Row keys, kinds, starts, ends (base spans and identifiers), entities and the contexts of them, one row per document. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, k_id, k_text = b.column("doc_id"), b.column("k_id"), b.column("k_text")
            kinds, starts, ends, names, marks = [], [], [], [], []
            for value in b.column("text"):
                text = value.as_py() or ""
                spans = base_spans(text)
                spans = sorted(spans + identifiers(text, spans))
                kinds.append([s[1] for s in spans])
                starts.append([s[0] for s in spans])
                ends.append([s[2] for s in spans])
                names.append(sorted({e for s in spans for e in (f"{KINDS[s[1]]}:{s[3]}", f"kind:{KINDS[s[1]]}")}))
                marks.append([{"entity": e, "term": t, "mark": m} for e, t, m in contexts(text, spans, window)])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids, k_id, k_text, pa.array(kinds, ints), pa.array(starts, ints), pa.array(ends, ints), pa.array(names, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("mark", pa.string())])))],
                names=["doc_id", "k_id", "k_text", "kinds", "starts", "ends", "entities", "near"],
            )

    return docs.select("doc_id", "text", *row_key()).mapInArrow(
        tidy(run), "doc_id long, k_id long, k_text long, kinds array<int>, starts array<int>, ends array<int>, entities array<string>, near array<struct<entity:string,term:string,mark:string>>"
    )


def disclosing_terms(docs: DataFrame, found: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, remove_at: float = REMOVE_AT) -> DataFrame:
    """entity, term, action of the pairs over the threshold. n(t) counts all documents, n(c) and n(c,t) those with the entity. An entity that every document holds has no information to disclose."""
    # Counted in two steps, so that the rows of a kind do not meet in one task. All counts are of rows, so that rows given twice leave the ratio as it is.
    marks = found.select(F.explode("near").alias("x")).select("x.*").groupBy("entity", "term", "mark").agg(F.lit(1).alias("one")).groupBy("entity", "term").agg(F.count("*").alias("n_marks"))
    beside = F.array_distinct(F.transform("near", lambda x: F.struct(x["entity"].alias("entity"), x["term"].alias("term"))))
    rows = found.select(F.explode(beside).alias("x")).groupBy("x.entity", "x.term").agg(F.count("*").alias("n_both"))
    pairs = marks.where(F.col("n_marks") >= support).join(rows, ["entity", "term"])
    n_entity = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    wanted = scratch(pairs.join(n_entity, "entity"), "pii-pairs")
    # Words of the corpus: 8-byte hashes summed on the map side before any row moves; only candidates are kept after.
    counts = _words(docs.select("text")).groupBy(F.xxhash64("w").alias("h")).agg(F.count("*").alias("n_term"))
    keys = wanted.select("term").distinct().select("term", F.xxhash64("term").alias("h"))
    n_term = keys.join(counts, "h").select("term", "n_term")
    total = docs.select(F.count("*").alias("n_docs"))
    ratio = F.log(F.col("n_both") * F.col("n_docs") / (F.col("n_entity") * F.col("n_term"))) / F.log(F.col("n_docs") / F.col("n_entity"))
    return (
        wanted.join(n_term, "term")
        .join(F.broadcast(total))
        .withColumn("ratio", F.when(F.col("n_entity") < F.col("n_docs"), ratio))
        .where(F.col("ratio") >= 1 / alpha)
        .select("entity", "term", F.when(F.col("ratio") >= remove_at, "remove").otherwise("generalise").alias("action"))
    )


def _words(docs: DataFrame) -> DataFrame:
    """docs with a row, and the word w in place of text, for each distinct word of each text."""
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "text"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_JAVA_WORD), F.lit(0)))).alias("w"))


def disclosed_in(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Row keys with the disclosing terms that the text holds, as a map from term to action; rows without any are left out. Equal rows give one."""
    listed = scratch(terms.groupBy("term").agg(F.max("action").alias("action")), "pii-listed")
    own = _words(docs.select("text", *row_key())).select("k_id", "k_text", F.col("w").alias("term")).join(listed, "term").distinct()
    return own.groupBy("k_id", "k_text").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("terms"))


def _all_spans(text: str, terms: dict[str, str]) -> list[tuple[int, int, int, str]]:
    """Base spans, identifiers and terms, by start, then kind. Terms inside other spans are not put out."""
    spans = base_spans(text)
    spans += identifiers(text, spans)
    if terms:
        taken, i = sorted((s[0], s[2]) for s in spans), 0
        for m in _WORD.finditer(text):
            if (action := terms.get(m[0].lower())) is None:
                continue
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            if i == len(taken) or taken[i][0] >= m.end():
                spans.append((m.start(), TERM, m.end(), action))
    spans.sort()
    return spans


def redact(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """Base spans and identifiers become [KIND]; terms become a shape, or go. Of overlapping spans the first in order is replaced, the others are cut to what follows it."""
    out, at = [], 0
    for start, kind, end, note in spans:
        if end <= at:
            continue
        out.append(text[at : max(at, start)])
        if kind != TERM:
            out.append(f"[{KINDS[kind].upper()}]")
        elif note == "generalise":
            out.append("[NUMBER]" if text[start:end].isdigit() else "[TERM]")
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, window: int = WINDOW) -> DataFrame:
    """docs with its columns, personal data and disclosing terms of `text` replaced, n_chars (where there) set anew. Null texts stay null.

    Columns other than doc_id and text pass through, whatever their names; an empty table gives an empty one.
    """
    found = scratch(detect_base(docs, window), "pii-found")
    terms = scratch(disclosed_in(docs, disclosing_terms(docs, found, alpha, support)), "pii-terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, held = b.column("text"), b.column("clipyard_terms")
            new = []
            for value, own in zip(texts, held, strict=True):
                text = value.as_py()
                new.append(None if text is None else redact(text, _all_spans(text, dict(own.as_py() or ()))))
            i = b.schema.get_field_index("text")
            yield b.set_column(i, "text", pa.array(new, pa.string())).drop_columns(["clipyard_terms"])

    id_key, text_key = row_key()
    keyed = docs.withColumns({"clipyard_id": id_key, "clipyard_text": text_key})
    terms = terms.select(F.col("k_id").alias("clipyard_id"), F.col("k_text").alias("clipyard_text"), F.col("terms").alias("clipyard_terms"))
    joined = keyed.join(terms, ["clipyard_id", "clipyard_text"], "left").select(*(F.col(f"`{c}`") for c in docs.columns), "clipyard_terms")
    out = joined.mapInArrow(tidy(run), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def spans_digest(kinds: list[int], starts: list[int], ends: list[int]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in zip(kinds, starts, ends, strict=True))


def find(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, window: int = WINDOW) -> DataFrame:
    """doc_id, base_kinds, base_starts, base_ends, kinds, starts, ends: base spans, then all spans by start, then kind; one row per row of docs. A null text is empty."""
    found = scratch(detect_base(docs, window), "pii-found")
    terms = scratch(disclosed_in(docs, disclosing_terms(docs, found, alpha, support)), "pii-terms")  # a table of known size, so that few terms are sent to the texts
    keyed = docs.select("text", *row_key())
    spans = scratch(keyed.join(terms, ["k_id", "k_text"]).mapInArrow(tidy(_term_spans), "k_id long, k_text long, t_starts array<int>, t_ends array<int>"), "pii-spans").dropDuplicates(["k_id", "k_text"])
    own = F.arrays_zip("starts", "kinds", "ends")
    more = F.transform(F.arrays_zip("t_starts", "t_ends"), lambda x: F.struct(x["t_starts"].alias("starts"), F.lit(TERM).alias("kinds"), x["t_ends"].alias("ends")))
    joined = found.join(spans, ["k_id", "k_text"], "left").withColumn("base", F.filter(own, lambda x: x["kinds"] < TERM))
    every = joined.withColumn("s", F.array_sort(F.concat(own, F.coalesce(more, F.array().cast("array<struct<starts:int,kinds:int,ends:int>>")))))
    return every.select("doc_id", *(F.col(f"base.{c}").alias(f"base_{c}") for c in ("kinds", "starts", "ends")), *(F.col(f"s.{c}").alias(c) for c in ("kinds", "starts", "ends")))


def _term_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        starts, ends = [], []
        for value, own in zip(b.column("text"), b.column("terms"), strict=True):
            spans = [s for s in _all_spans(value.as_py() or "", dict(own.as_py())) if s[1] == TERM]
            starts.append([s[0] for s in spans])
            ends.append([s[2] for s in spans])
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("k_id"), b.column("k_text"), pa.array(starts, ints), pa.array(ends, ints)], names=["k_id", "k_text", "t_starts", "t_ends"])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(k) for k in KINDS))

    def digest(kinds: str, starts: str, ends: str):
        one = F.transform(F.arrays_zip(kinds, starts, ends), lambda x: F.concat_ws(":", F.element_at(names, x[kinds] + 1), x[starts], x[ends]))
        return F.array_join(one, ",")

    count = lambda i, c="base_kinds": F.size(F.filter(c, lambda x: x == i)).cast("long")
    return out.select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])), F.sha2(digest("base_kinds", "base_starts", "base_ends").cast("binary"), 256).alias("base_sha256"), digest("kinds", "starts", "ends").alias("spans"), count(TERM, "kinds").alias("n_term"), count(SECRET, "kinds").alias("n_secret"), F.size("kinds").cast("long").alias("n_spans")
    )
