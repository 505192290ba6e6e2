"""Values of each operator and pipeline stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import tracemalloc

import pytest

import corpus_pipeline
from clipyard.llm import chains, decontaminate, fingerprints, graph, langid, licenses, ngram_join, pieces, pii, suffix_dedup, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, labels string, item_id long, component_id long, fingerprint string, spans string, ids string"
LONG, TIGHT, MAIL = "palabra " * 20_000, "ab" * 30_000, "a mail a@b.co under the MIT License here"
ROWS = [(1, None), (2, ""), (3, LONG), (3, LONG), (None, MAIL), (5, "x"), (5, "y"), (6, " \n\t "), (7, TIGHT)]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None, "q", 0.5, "z", 9, 9, "f", "s", "i") for i, t in ROWS], DOCS)


def by_id(df, *columns):
    """Sorted tuples of the columns, doc_id first and null as -1."""
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select("doc_id", *columns).collect())


def test_personal_data(odd):
    spans = {r["doc_id"]: (r["kinds"], r["starts"], r["ends"]) for r in pii.find(odd).collect()}
    assert spans == {i: ([], [], []) for i in (1, 2, 3, 5, 6, 7)} | {None: ([0], [7], [13])}
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns
    want = [(i, MAIL.replace("a@b.co", "[EMAIL]") if t == MAIL else t) for i, t in ROWS]
    assert collections.Counter((r["doc_id"], r["text"]) for r in clean.collect()) == collections.Counter(want)


def test_language(odd, spark):
    known = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(known.where(~langid.held_out()))
    got = by_id(langid.predict(odd, model), "lang_pred", "rejected")
    labels = set(model.labels)
    assert [g for g in got if g[0] in (1, 2, 6)] == [(1, "und", True), (2, "und", True), (6, "und", True)]
    assert len(got) == 9 and all(g[1] in labels for g in got if g[0] in (-1, 3, 5, 7)) and got.count(next(g for g in got if g[0] == 3)) == 2
    assert {g[1] for g in by_id(langid.predict(odd, langid.fit(odd)), "lang_pred")} == {"und"}  # nothing was learned


def test_licenses(odd):
    assert by_id(licenses.scan(odd), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels") == [
        (-1, 10, 1, 5, 5, "mit", "mit"), *((i, n, 0, -1, -1, "", "") for i, n in ((1, 0), (2, 0), (3, 20_000), (3, 20_000), (5, 1), (5, 1), (6, 0), (7, 1)))
    ]


def test_sentencepiece(odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.encode(odd)
    want = sorted((-1 if i is None else i, sp.encode(t or "")) for i, t in ROWS)
    assert by_id(got, "ids") == want and all(r["round_trip"] for r in got.collect())


def test_suffixes(odd):
    kept = {-1: MAIL, 5: None, 6: " \n\t "}
    for i, n, gone, spans, left in by_id(suffix_dedup.dedup(odd), "n_bytes", "n_removed", "n_spans", "kept"):
        assert (n, gone, spans) == {-1: (40, 0, 0), 3: (160_000, 160_000, 1), 5: (1, 0, 0), 6: (4, 0, 0), 7: (60_000, 60_000, 1)}.get(i, (0, 0, 0))
        assert bytes(left).decode() in (["x", "y"] if i == 5 else [kept.get(i, "")])


def test_join_and_components(odd):
    assert by_id(ngram_join.component_ids(odd, 5, 80), "n_shingles", "component_id") == [(-1, 4, -1), (1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (5, 1, 5), (5, 1, 5), (6, 0, 6), (7, 1, 7)]
    assert ngram_join.one_of_each(odd).columns == odd.columns


def test_fingerprints_of_odd_texts(odd):
    rows = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    text = [t or "" for _, t in rows]
    want = sorted((-1 if i is None else i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + text[(k + 1) % len(text)][: len(t) // 2]).encode()).hexdigest()) for k, ((i, _), t) in enumerate(zip(rows, text, strict=True)))
    assert by_id(fingerprints.compare_edited(odd, buckets=3), "n_chars", "edited_sha256") == want
    one = fingerprints.compare_edited(odd.where("doc_id = 7"), buckets=3).first()
    assert (one["near_edited"], one["near_next"]) == (fingerprints.compare_edited(odd.where("doc_id = 7"), buckets=1).first()["near_edited"], 1.0)


def _terms(text):
    words = text.lower().split() or [""]
    return {t: 1 + math.log(n) for t, n in collections.Counter(zip(words, [*words[1:], None], strict=True)).items()}


def test_likeness_against_generalised_jaccard(spark):
    rng = random.Random(31)
    pairs = []
    for i in range(240):
        a = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(150, 400))]
        cut = int(len(a) * rng.random())
        pairs.append((i, " ".join(a), " ".join(a[:cut] + [f"v{rng.randrange(400)}" for _ in range(len(a) - cut)])))
    rows = [(2 * i + k, t) for i, *both in pairs for k, t in enumerate(both)]
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = spark.createDataFrame([(i, prints[2 * i], prints[2 * i + 1]) for i, *_ in pairs], "i long, a string, b string")
    got = {r["i"]: r["x"] for r in got.select("i", fingerprints.likeness(got["a"], got["b"]).alias("x")).collect()}
    off = []
    for i, a, b in pairs:
        a, b = _terms(a), _terms(b)
        off.append(got[i] - sum(min(a.get(t, 0), b.get(t, 0)) for t in {*a, *b}) / sum(max(a.get(t, 0), b.get(t, 0)) for t in {*a, *b}))
    mean = sum(off) / len(off)
    assert abs(mean) <= 0.02 and math.sqrt(sum((x - mean) ** 2 for x in off) / len(off)) <= 0.07 and max(map(abs, off)) <= 0.25


def test_chains_of_odd_texts(spark, odd):
    got = by_id(chains.repeated(odd), "n_passages", "first_ids", "n_copies")
    assert [g for g in got if g[0] != 3] == [(i, 0, [], 0) for i in (-1, 1, 2, 5, 5, 6, 7)]
    text = " ".join(f"w{i}" for i in range(70))
    d = spark.createDataFrame([(None, text), (4, text), (-1, text + " more")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_passages"], r["spans"], r["first_ids"], r["n_copies"]) for r in chains.repeated(d).collect()) == [(-1, 1, "0:70", [], 0), (0, 0, "", [], 2), (4, 1, "0:70", [], 0)]


def test_extension_over_added_and_lost_words():
    import numpy as np

    rng = random.Random(5)

    def plain(a, b):
        """The best score over all prefixes, without bounds."""
        score = {(0, 0): (0, 0)}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                near = [(score[p][0] + g, score[p][1] + m) for p, g, m in (((i - 1, j - 1), 1 if i and j and a[i - 1] == b[j - 1] else -2, int(i > 0 and j > 0 and a[i - 1] == b[j - 1])), ((i - 1, j), -2, 0), ((i, j - 1), -2, 0)) if p in score]
                score[i, j] = max(near, default=(0, 0))
        return max(score.values())

    for _ in range(200):
        a = [rng.randrange(1000) for _ in range(rng.randrange(0, 60))]
        b = list(a)
        at = 9
        while at < len(b):
            b[at : at + 1] = rng.choice([[], [b[at], 5000], [5001]])
            at += rng.randrange(8, 14)
        n, m, same = chains._extend(np.array(a, np.uint32), np.array(b, np.uint32))
        score = plain(a, b)
        assert same == score[1] and plain(a[:n], b[:m]) == score
    assert chains._extend(np.array([1, 2, 3]), np.array([4, 5, 6])) == (0, 0, 0) and chains._extend(np.array([], int), np.array([1])) == (0, 0, 0)


def test_leaks_of_repeated_rows_and_clashing_columns(spark):
    item = "zeta eta theta iota"
    bench = spark.createDataFrame([(1, None), (2, item), (3, "")], "item_id long, text string")
    d = spark.createDataFrame([(1, item, 7, 0.5), (1, item, 7, 0.5), (None, item, 7, 0.5), (2, None, 7, 0.5), (3, "zeta eta other words", 7, 0.5)], "doc_id long, text string, item_id long, score double")
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in decontaminate.leaks(d, bench).collect()} == {(1, 2, 1.0), (None, 2, 1.0)}
    left = decontaminate.clean(d, bench)
    assert left.columns == d.columns and by_id(left, "text") == [(2, -1), (3, "zeta eta other words")]  # rows with a passage go as a whole
    assert decontaminate.clean(d, bench.limit(0)).exceptAll(d).count() == 0


def test_archives_of_odd_pages(spark):
    big = "w" * 1200
    d = spark.createDataFrame([(1, "u", "<p>", "x", 3), (None, None, None, "x", 3), (2, "u", big, "x", 3), (3, None, big, "x", 3)], "page_id long, url string, html string, record_type string, payload_bytes long")
    got = sorted(((r["page_id"] or -1), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(warc.write(warc.plan(d))).collect())
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got == [(-1, 0, sha(""), "response", None), (1, 3, sha("<p>"), "response", None), (2, 1200, sha(big), "revisit", 3), (3, 1200, sha(big), "response", None)]
    assert warc.read(warc.write(warc.plan(d.limit(0)))).count() == 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    n = len(stage(spark, odd, SF).collect())
    assert n == 9 or name == "language ID" and n <= 6  # those without a letter go
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_chains_recall_of_changed_added_and_lost_words(spark):
    rng = random.Random(77)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    rows = []
    for i in range(60):
        p, q = some(60), []
        for k, w in enumerate(p):
            q += rng.choice([[word()], [w, word()], []]) if k % 15 == 7 else [w]
        rows += [(2 * i, " ".join(some(40) + p + some(40))), (2 * i + 1, " ".join(some(30) + q + some(50)))]
    got = {r["doc_id"]: r["first_ids"] for r in chains.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1] == [2 * i] for i in range(60)) >= 54 and not any(got[2 * i] for i in range(60))


def test_chains_find_all_passages_above_the_threshold(spark):
    rng = random.Random(78)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    rows = []
    for i, (n, every) in enumerate([(n, e) for n in (51, 60, 120) for e in (5, 6, 8, 10, 0) for _ in range(8)]):
        p = some(n)
        changed = {*range(3, n - 1, every)} if every else {*rng.sample(range(1, n - 1), n // 5)}
        rows += [(2 * i, " ".join(some(40) + p + some(40))), (2 * i + 1, " ".join(some(30) + [word() if k in changed else w for k, w in enumerate(p)] + some(50)))]
    got = {r["doc_id"]: (r["first_ids"], r["n_repeated"]) for r in chains.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(len(rows) // 2):
        assert got[2 * i] == ([], 0) and got[2 * i + 1][0] == [2 * i] and got[2 * i + 1][1] >= max(50, 0.8 * (51, 60, 120)[i // 40])


def test_chains_of_words_that_stand_in_many_places(spark):
    rng = random.Random(79)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    p, line = some(70), some(8)
    rows = [(i, some(20) + p[:35] + some(20) + line + p[31:]) for i in range(chains.MOST + 5)] + [(100 + i, some(30) + p + some(9) + line) for i in range(3)]
    rows += [(200, some(30) + [word() if k % 8 == 4 else w for k, w in enumerate(p)])]
    got = {r["doc_id"]: (r["first_ids"], r["spans"]) for r in chains.repeated(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()}
    assert got[101] == got[102] == ([100], "30:100") and got[0] == ([], "")
    assert set(got[200][0]) <= {100, 101, 102}


def test_encoding_holds_little_at_once():
    import pyarrow as pa

    rng = random.Random(80)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)) for _ in range(1000)]
    encoder = pieces.Encoder(pieces.load())
    tracemalloc.start()
    n = sum(len(i) for _, part in pieces._parts(pa.array(texts)) for i in encoder.encode(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 1000 * 400 and peak < 70e6


def test_components_take_few_exchanges(spark):
    """A round of stars deals its edges out three times at most; components equal those of a plain search."""
    rng = random.Random(11)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)] + [(500, i) for i in range(501, 560)] + [(3, 3)]
    edges = spark.createDataFrame(links, "u long, v long")
    assert graph._small_star(graph._large_star(edges))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3
    root = {x: x for link in links for x in link}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        lo, hi = sorted((top(u), top(v)))
        root[hi] = lo
    assert sorted(tuple(r) for r in graph.components(edges).collect()) == sorted((x, top(x)) for x in root if top(x) != x)


def test_language_model_in_little_memory(spark):
    """The driver holds the sampled vectors, 48 MB here, once, and part of them again while it sorts and clusters."""
    rows = spark.range(3000).selectExpr("id AS doc_id", "'some words of the number ' || id AS text", "IF(id % 2 = 0, 'a', 'b') AS lang")
    langid.fit(rows)
    tracemalloc.start()
    model = langid.fit(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(model.labels) == {"a", "b"} and peak < 150e6


def test_chains_give_every_match_in_any_order_of_texts(spark):
    """A seed in few places links all of them, within a run too, whatever order the texts come in."""
    import pyarrow as pa

    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    texts = [" ".join(base), " ".join(base[300:]), " ".join(["x", "y", *base])]
    want = sorted([(11, 10, p, p + 300) for p in range(597)] + [(12, 10, p + 2, p) for p in range(897)] + [(12, 11, p + 2, p - 300) for p in range(300, 897)])
    for order in ((0, 1, 2), (2, 0, 1)):
        batch = pa.RecordBatch.from_arrays([pa.array(order), pa.array([10 + i for i in order]), pa.array([texts[i] for i in order])], names=["k_id", "k", "text"])
        got = [tuple(r.values()) for b in chains._matched(chains._grams(50, False, 1)(iter([batch]))) for r in b.to_pylist()]
        assert sorted(got) == want


def test_chains_of_matches_in_single_batches(spark):
    """Matches that stand alone are in no chain; those that a batch's end parts from their company are."""
    import pyarrow as pa

    rows = [(1, 2, 5, 5), (1, 2, 90, 40), (1, 2, 94, 44), (1, 3, 100, 52), (1, 3, 190, 52), (2, 3, 0, 0), (2, 3, 20, 20), (2, 3, 65, 65)]
    for size in (1, 2, 3, 8):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[lo : lo + size]], pa.int64() if i < 2 else pa.int32()) for i in range(4)], names=["k", "l", "pos", "l_pos"]) for lo in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in chains._chains(iter(batches)) for r in b.to_pylist()]
        assert got == [(1, 2, [90, 94], [40, 44]), (2, 3, [0, 20], [0, 20])]


def test_chains_matches_move_in_few_bytes():
    """Packed matches are those of the seeds, once each, in few bytes a match; seeds of many places are in the bitmap."""
    import pyarrow as pa

    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    texts = [" ".join([*(f"x{i}{k}" for k in range(rng.randrange(9))), *base[rng.randrange(300) :]]) for i in range(20)] + ["all of one line"] * (chains.MOST + 1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([1000 - 7 * i for i in range(len(texts))]), pa.array(texts)], names=["k_id", "k", "text"])
    seeds = list(chains._grams(50, False, 3)(iter([batch])))
    want = {tuple(r.values()) for b in seeds for s in range(b.num_rows) for m in chains._matched(iter([b.slice(s, 1)])) for r in m.to_pylist()}
    rows = [r for b in chains._packed(4, True, 3)(iter(seeds)) for r in b.to_pylist()]
    got = [m for r in rows if r["part"] >= 0 for m in zip(*(v.tolist() for v in chains._unpack(r["data"])), strict=True)]
    assert len(got) == len(want) and set(got) == want and sum(len(r["data"]) for r in rows if r["part"] >= 0) < 2 * len(got)
    bits = [r["data"] for r in sorted((r for r in rows if r["part"] < 0), key=lambda r: r["bucket"])]
    assert len(bits) == 3 and sum(int.from_bytes(b, "little").bit_count() for b in bits) == 1


def test_chains_of_runs_are_those_of_matches():
    rng = random.Random(10)
    for _ in range(200):
        runs, at = [], (rng.randrange(9), rng.randrange(9))
        for _ in range(rng.randrange(1, 9)):
            runs.append((*at, n := rng.randrange(1, 9)))
            at = at[0] + n + rng.randrange(1, 60), at[1] + n + rng.randrange(1, 60)
        matches = [(x + i, y + i) for x, y, n in runs for i in range(n)]
        want = chains.chain(*(list(v) for v in zip(*matches, strict=True)), chains.SEED)
        assert [[(x + i, y + i) for x, y, n in one for i in range(n)] for one in chains.linked(runs)] == [[matches[i] for i in one] for one in want]
