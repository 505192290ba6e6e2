"""Token counts against the library, fill-in-middle and ranked search against plain versions, and the edge cases of all three."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from clipyard.llm import infill, queries, ranked, token_counts

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, n string, counts string, form string, output string, score string, rank string, term string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those of the operators."""
    rows = [(1, None), (2, ""), (3, "palabra " * 20_000), (3, "palabra " * 20_000), (None, "a mail a@b.co"), (5, "x"), (5, "y"), (6, " \n\t "), (7, "ab" * 30_000), (8, "-" * 5000)]
    return spark.createDataFrame([(i, t, *"abcdefg") for i, t in rows], ODD)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    return lambda text: len(held.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.load())


# --- token counts ------------------------------------------------------------------------------


def test_every_prefix_by_the_library(counter, library):
    rng = random.Random(5)
    some = [*"ab the  \n\t'rsvel12!.-éß中", " ", "\x1c", " ", "<|endoftext|>", "<|endof", "'re", "'ll", "'d", "  ", "՘", "😀", "\x00", "\r\n"]
    for _ in range(600):
        text = "".join(rng.choice(some) for _ in range(rng.randrange(30)))
        assert counter.tables([text])[0].tolist() == [library(text[: i + 1]) for i in range(len(text))], text


def test_words_of_many_tokens(counter, library):
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshrdlu" if rng.random() < 0.9 else "ÀßñZ9'") for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    for text in [" ".join(words[i : i + 20]) for i in range(0, 400, 20)] + [" " * 200 + "x", "=" * 300, "\n" * 50, "a" * 1000]:
        assert counter.tables([text])[0].tolist() == [library(text[: i + 1]) for i in range(len(text))]


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECES", 3)
    monkeypatch.setattr(token_counts, "PAIR_BITS", 2)
    monkeypatch.setattr(token_counts, "WORDS", 2)
    own = token_counts.Counter(token_counts.load())
    texts = ["one two three four five", "two three", "six one, two!", "five six"]
    for _ in range(2):
        for t in texts:
            assert own.tables([t])[0].tolist() == [library(t[: i + 1]) for i in range(len(t))]


def test_token_counts_query(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op11_token_counts"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {i: (len(t.encode()), n := library(t), n > 512) for i, t in docs.items()}
    for r in got[:40]:
        t, k = docs[r["doc_id"]], r["chars_within"]
        assert library(t[:k]) <= 512 and (k == len(t) or library(t[: k + 1]) > 512)


def test_budget_and_truncation(spark, library):
    rows = [(1, "Some words, and - more words."), (2, ""), (3, None), (4, "-" * 64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = token_counts.prefix_counts(docs)
    got = {r["doc_id"]: r for r in held.select("doc_id", token_counts.tokens_of(F.col("counts"), 7).alias("t"), token_counts.longest_within(F.col("counts"), 3).alias("c"), F.size("counts").alias("n")).collect()}
    text = rows[0][1]
    longest = lambda t, b: max((i + 1 for i in range(len(t)) if library(t[: i + 1]) <= b), default=0)
    assert got[1]["t"] == library(text[:7]) and got[1]["c"] == longest(text, 3) and got[2]["t"] == got[2]["c"] == got[2]["n"] == 0 and got[3]["n"] == 0
    assert got[4]["c"] == longest("-" * 64, 3)  # longer prefixes can have fewer tokens
    cut = {r["doc_id"]: (r["text"], r["n_tokens"]) for r in token_counts.truncated(docs, 3).collect()}
    assert cut[1] == (text[: longest(text, 3)], 3) and cut[2] == ("", 0) and cut[3] == (None, 0)


def test_token_counts_of_odd_rows(spark, odd, library):
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(odd).collect())
    want = sorted((r["doc_id"] or 0, len(t := (r["text"] or "").encode()), n := library(t.decode()), n > 512) for r in odd.collect())
    assert got == want and token_counts.count_tokens(odd.limit(0)).count() == 0 == token_counts.prefix_counts(odd.limit(0)).count()


# --- fill-in-middle ----------------------------------------------------------------------------


def _formed(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return n, *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


@pytest.mark.parametrize("bits,longest,held", [(8, 4096, 16_000_000), (2, 40, 100)])
def test_infill_by_plain_units(spark, monkeypatch, bits, longest, held):
    for name, value in (("CUT_BITS", bits), ("LONGEST", longest), ("CACHE_BYTES", held)):
        monkeypatch.setattr(infill, name, value)
    rng = random.Random(7)
    shared = ["".join(rng.choice("abcXYZ .,é中😀\n") for _ in range(rng.randrange(200))) for _ in range(8)]
    raw = [("".join(rng.choice(shared) for _ in range(rng.randrange(12)))).encode() for _ in range(60)] + [b"", b"abc" * 400, b"", "é".encode() * 300]
    cache = infill.Summaries()
    for lo in range(0, len(raw), 16):
        part = raw[lo : lo + 16]
        texts = infill.Texts(part, cache)
        for k, t in enumerate(part):
            units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t.decode())
            assert texts.count(k) == len(units)
            for i in {0, 1, len(units) // 2, len(units)} - {x for x in (1,) if not units}:
                before = "".join(units[:i])
                assert texts.cut(k, i) == (len(before.encode()), len(before))


def test_chunks_follow_content():
    rng = random.Random(8)
    same = bytes(rng.randrange(97, 123) for _ in range(20_000))
    cut = lambda t: {t[a:b] for e in [infill.chunk_ends(np.frombuffer(t, np.uint8), np.array([0, len(t)]))] for a, b in zip(np.append(0, e[:-1]), e)}
    one, two = cut(b"some beginning " + same), cut(b"another one " + same + b" and an end")
    assert len(one & two) >= len(one) - 3 and max(map(len, one | two)) <= infill.LONGEST


def test_infill_of_odd_rows(spark, odd):
    marked = spark.createDataFrame([(11, "a <S> b"), (12, "<" * 40 + ">"), (13, "<P"), *((100 + i, f"some text number {i}, <S and P>") for i in range(200))], "doc_id long, text string")
    docs = odd.where("doc_id IS NOT NULL").select("doc_id", "text").unionByName(marked)
    out = infill.fill_in_middle(docs).withColumn("again", infill.restored(F.col("output"), F.col("form")))
    got = sorted(((r["doc_id"], r["again"]), (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in out.collect())
    want = sorted(((r["doc_id"], r["text"] or ""), _formed(r["doc_id"], r["text"] or "")) for r in docs.collect())
    assert got == want and {f for _, (_, f, *_) in got} == {"plain", "psm", "spm"}
    null = infill.fill_in_middle(odd.where("doc_id IS NULL")).collect()
    assert [(r["n"], r["output"]) for r in null] == [(9, _formed("", "a mail a@b.co")[4])] and infill.fill_in_middle(odd.limit(0)).count() == 0


# --- ranked search -----------------------------------------------------------------------------


def _ranked(docs, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in own if c), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(words(t))
    out = []
    for item, ts in wanted.items():
        rows = []
        for i, c in own:
            m = 10 + (90 * c.total() * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                rows.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(rows)[:k])]
    return out


@pytest.mark.parametrize("rows,block,short", [(4096, 128, 1 / 16), (7, 2, 1 / 3), (50, 8, 0), (50, 8, 1)])
def test_ranks_by_plain_sums(spark, rows, block, short):
    shape = ranked.Shape(rows, 8_000_000, block, short)
    rng = random.Random(9)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 300}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(300)] + [(500 + i, "Same w1 W2 w7") for i in range(30)] + [(900, None), (901, ""), (None, "w1 w2 w7 same"), (3, "w5 w5")]
    items = [(i, " ".join(word() for _ in range(8))) for i in range(12)] + [(50, "same w7"), (51, None), (52, "..."), (53, "absent"), (54, "w1"), (54, "w9")]
    best = ranked.Best(10)
    assert best.bar() == 1
    held, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in ranked.rank(held, q, shape=shape).select("item_id", "rank", "doc_id", "score").collect()]
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(_ranked(docs, items), key=key)
    assert sorted((tuple(r) for r in ranked.rank(held, q, block_chars=40, shape=shape).select("item_id", "rank", "doc_id", "score").collect()), key=key) == sorted(got, key=key)


def test_blocks_below_the_bar_are_skipped():
    rng = np.random.default_rng(3)
    n = 128 * 64
    place = np.arange(n)
    score = rng.integers(1, 50, n)
    score[128 * 5 : 128 * 5 + 20] += 1000
    top = score.reshape(-1, 128).max(axis=1)
    best = ranked.Best(10)
    assert ranked.search_segment([(place, score, top)], list(range(n)), best) == 128 and best.rows[0][0] == score.max()


def test_ranks_of_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "palabra mail X", "z"), (2, None, "z")], "item_id long, text string, doc_id string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = [tuple(r) for r in ranked.rank(odd, items).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got) == sorted(_ranked(rows, [(1, "palabra mail X")]))
    assert ranked.rank(odd.limit(0), items).count() == 0 == ranked.rank(odd, items.limit(0)).count()


@pytest.mark.parametrize("name", ["op12_infill", "op13_ranked_search", "personal_data_counts", "license_words", "edited_texts"])
def test_new_operators_equal_sql(spark, name):
    assert oracle.compare(oracle.connect(SF), queries.QUERIES[name](spark, SF), queries.SQL[name]) is None
