"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

import collections
import random
import re

import duckdb
import oracle
import pytest

from clipyard.llm import chains, decontaminate, fingerprints, langid, licenses, ngram_join, pieces, pii, queries, suffix_dedup, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, labels string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, clashing columns."""
    long = "palabra " * 20_000
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "a mail a@b.co under the MIT License here"), (5, "x"), (5, "y"), (6, " \n\t "), (7, "ab" * 30_000)]
    return spark.createDataFrame([(i, t, None, None, None, "q", 0.5, "z") for i, t in rows], DOCS)


def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_base_spans_by_regular_expressions():
    rng = random.Random(1)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(3000):
        t = "".join(rng.choice("ab1._@@-+ ") for _ in range(30))
        assert [(s[0], s[2]) for s in pii.base_spans(t) if s[1] == 0] == [m.span() for m in email.finditer(t)]
    assert [(pii.KINDS[s[1]], s[0], s[2]) for s in pii.base_spans("4111 1111 1111 1111, 10.0.0.255, 10.0.0.256, +1 (386) 555-3733")] == [("card", 0, 19), ("ip", 21, 31), ("phone", 45, 62)]


def test_pii_terms_and_redaction(spark):
    rows = [(i, f"word{i}a word{i}b secretname x@y.org word{i}c") for i in range(6)] + [(100 + i, f"plain text number{i}") for i in range(60)] + [(200, "a secretname alone"), (201, "key 9f86d081884c7d659a2feaa0c55ad015 end")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(d).collect()}
    assert got[0]["kinds"] == [4, 0] and got[0]["base_kinds"] == [0] and got[100]["kinds"] == [] and got[200]["kinds"] == [4] and got[201]["kinds"] == [5] and got[201]["base_kinds"] == []
    clean = texts(pii.sanitise(d))
    assert clean[0] == "word0a word0b [TERM] [EMAIL] word0c" and clean[100] == "plain text number0" and clean[200] == "a [TERM] alone" and clean[201] == "key [SECRET] end"


def test_pii_terms_by_brute_force(spark):
    rng = random.Random(21)
    some = lambda: " ".join(rng.choice([f"w{i}" for i in range(100, 400)]) for _ in range(rng.randrange(5, 60)))
    hints, values = ["phonehint", "mailhint", "both"], ["a@b.org", "c@d.org", "+1 (386) 555-3733", "+1 (386) 555-4444"]
    every = [" ".join([some(), *([rng.choice(hints), rng.choice(values)] if rng.random() < 0.3 else []), some(), *([hints[0], values[2]] if rng.random() < 0.2 else [])]) for _ in range(150)]
    word = lambda t: re.findall(r"[^\W_]{3,}", t.lower())
    n, n_c, n_t, both, marks = len(every), collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for t in every:
        spans = pii.base_spans(t)
        outside = t
        for s in spans:
            outside = outside[: s[0]] + "\0" * (s[2] - s[0]) + outside[s[2] :]
        beside = set()
        for s in spans:
            left, right = word(outside[: s[0]])[-6:], word(outside[s[2] :])[:6]
            for e in (f"{pii.KINDS[s[1]]}:{s[3]}", f"kind:{pii.KINDS[s[1]]}"):
                for w in {*left, *right}:
                    beside.add((e, w))
                    marks[e, w].add((*left, "|", *right))
        n_c.update({e for s in spans for e in (f"{pii.KINDS[s[1]]}:{s[3]}", f"kind:{pii.KINDS[s[1]]}")})
        n_t.update(set(word(t)))
        both.update(beside)
    log = __import__("math").log
    ratio = {(e, w): log(k * n / (n_c[e] * n_t[w])) / log(n / n_c[e]) for (e, w), k in both.items() if len(marks[e, w]) >= pii.SUPPORT}
    want = {(e, w): "remove" if r >= pii.REMOVE_AT else "generalise" for (e, w), r in ratio.items() if r >= 1 / pii.ALPHA}
    d = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    got = {(r["entity"], r["term"]): r["action"] for r in pii.disclosing_terms(d, pii.detect_base(d)).collect()}
    assert got == want and ("kind:phone", "phonehint") in got and len(got) > 1


def test_language_on_held_out_rows(spark, docs):
    out = langid.predict(docs.withColumn("held_out", langid.held_out()), langid.fit(docs.where(~langid.held_out()))).where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)


def test_language_clusters_and_rejection(spark, docs):
    model = langid.fit(docs.where(~langid.held_out()))
    assert all(model.labels.count(lang) >= 2 for lang in set(model.labels))
    other = ["Съешь же ещё этих мягких французских булок да выпей чаю, и пусть всё будет хорошо в этом доме", "我能吞下玻璃而不伤身体，这是一个很长的句子，用来测试语言识别的拒绝", "zxqj kvvw qqpz xkcd vbnm hjkl zzzz wqwq xvxv jjkk ppqq zzxx", "12345 6789"]
    got = langid.predict(spark.createDataFrame(list(enumerate(other)), "doc_id long, text string"), model).collect()
    assert all(r["rejected"] for r in got)
    known = langid.predict(docs.where(langid.held_out()), model).where("lang_pred = lang AND length(text) > 20")
    assert known.where("rejected").count() <= 0.02 * known.count()


def test_language_learns_every_language(spark):
    rows = [(i * 10 + k, f"l{i:03}", " ".join([chr(0x4E00 + i) * 3, chr(0x4E00 + i) * 2, "abc"[: k % 3]])) for i in range(230) for k in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    out = langid.predict(d, langid.fit(d)).collect()
    assert {r["lang"] for r in out if r["lang"] == r["lang_pred"]} == {r[1] for r in rows}


def test_licenses_by_words(docs):
    got = {r["doc_id"]: r for r in licenses.scan(docs.select("doc_id", "text")).collect()}
    for i, t in texts(docs).items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(w), len(places))
        assert (got[i]["first_word"], got[i]["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert got[i]["base_labels"] == ",".join(sorted({p[1] for p in places}))
    assert len(licenses.rules()) > 300


def test_license_suppression(spark):
    d = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0."), (2, "This work is licensed under the GNU General Public License, version 3.")], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(d).collect()}
    assert got == {1: "cc-by-nc,cc-by-nc-4.0", 2: "gpl-3"}


def _ungated(text):
    """Labels of all rules run over the whole text."""
    w = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()))
    found = [(m.start(), m.end(), r["rank"], r["label"]) for r in licenses.rules() for m in re.finditer(r["regex"], w)]
    left, kept = set(found), set()
    while left:  # the best of what is left stays, and all that it contains or lies in goes
        best = min(left, key=lambda m: (m[2], m[0] - m[1], m[3], m[0]))
        kept.add(best[3])
        left = {m for m in left if not (m[0] <= best[0] and best[1] <= m[1] or best[0] <= m[0] and m[1] <= best[1])}
    return ",".join(sorted(kept | {label for phrase, label in licenses.PHRASES if f" {phrase} " in f" {w} "}))


def test_licenses_against_an_ungated_scan(spark, docs):
    far = " ".join(f"w{i}" for i in range(17))
    odd = [
        "Released under Apache 2.0", "distributed under the BSD 3-Clause", f"license {far} released under the terms of the GNU General Public License version 2", "published under attribution share alike 4.0",
        "released under zero clause BSD", "licensed under Responsible AI", "provided under open data commons attribution license", "redistribute it and/or modify it under the terms of the GNU General Public License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
        "modify it under: redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "https://creativecommons.org/licenses/by-nc-sa/4.0/ and https://creativecommons.org/licenses/by/3.0/",
        "Neither the name of the Foo Bar Institute nor the names of its contributors may be used to endorse or promote products derived from this software", "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", f"GPL license {far} {far} {far} licensed under the GPL version 3, MIT license MIT license",
    ]
    every = {i: t for i, t in enumerate(odd)} | {1000 + i: t for i, t in list(texts(docs).items())[:400]}
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(every.items()), "doc_id long, text string")).collect()}
    assert got == {i: _ungated(t) for i, t in every.items()} and all(got[i] for i in range(len(odd)))


def test_a_suppressed_license_suppresses_nothing(spark):
    t = "Neither the name of Foo, licensed under Apache 2.0, nor GPL license text, may be used to endorse or promote products derived from this software"
    got = licenses.scan(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()["labels"]
    assert got == _ungated(t) and {"apache-2", "gpl"} <= set(got.split(","))


def test_pii_terms_of_rows_given_twice(spark):
    rows = [(i, f"word{i}a word{i}b secretname x@y.org word{i}c") for i in range(6)] + [(100 + i, f"plain text number{i}") for i in range(60)]
    terms = lambda r: sorted(map(tuple, pii.disclosing_terms(d := spark.createDataFrame(r, "doc_id long, text string"), pii.detect_base(d)).collect()))
    assert terms(rows) == terms(rows + rows) and terms(rows)


def test_sentencepiece_ids_and_round_trip(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    every = [t for t in texts(docs).values() if t] + ["  a b ", "", "ßé 你好 ​ x", "   ", "😀 family", "aaaaaaaaaaaaaaa" * 9, "x\x01\ty", "a\0b \0\0c", "ab" * 20_000, "thequickbrownfox" * 3_000]
    encoder = pieces.Encoder(pieces.load())
    for t, ids in zip(every, encoder.encode(every), strict=True):
        assert ids.tolist() == sp.encode(t) and encoder.decode(ids) == t


def test_suffix_dedup_by_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(6)]
    every = {i: rng.choice(base)[rng.randrange(150) :] + rng.choice(["", "é", "zz"]) + rng.choice(base)[: rng.randrange(100, 400)] for i in range(40)} | {40: "q" * 700, 41: "short"}
    seen = collections.Counter(b[k : k + 200] for b in (t.encode() for t in every.values()) for k in range(len(b) - 199))
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.dedup(spark.createDataFrame(list(every.items()), "doc_id long, text string")).collect()}
    for i, t in every.items():
        b = t.encode()
        gone = {j for k in range(len(b) - 199) if seen[b[k : k + 200]] > 1 for j in range(k, k + 200)}
        assert got[i] == (len(gone), bytes(x for j, x in enumerate(b) if j not in gone))


def test_ngram_join_by_brute_force(docs):
    sets = {}
    for i, t in texts(docs).items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.component_ids(docs, 4, 85).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    assert oracle.compare(oracle.connect(SF), queries.QUERIES[name](spark, SF), queries.SQL[name]) is None


def test_decontamination_finds_every_exact_passage(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(i, b["item_id"]) for i, t in texts(docs).items() for b in bench.collect() if b["text"] in (t or "")}


def test_decontamination_finds_edited_copies_beside_a_verbatim_one(spark):
    item = [f"w{i}" for i in range(40)]
    edited = lambda at: " ".join("zz" if i % 6 == at else w for i, w in enumerate(item))
    d = spark.createDataFrame([(1, " ".join(item)), *((2 + at, f"before {edited(at)} after") for at in range(6)), (9, "something else")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontaminate.leaks(d, bench).collect()}
    assert set(got) == set(range(1, 8)) and got[1] == 1 and all(got[i] >= 26 / 40 for i in range(2, 8))


@pytest.mark.parametrize("percent", [0, 5, 10, 15, 20])
def test_decontamination_recall_of_edited_copies(percent):
    rng = random.Random(percent)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(40)] for _ in range(60)]
    held = decontaminate.items_of([(i, " ".join(w)) for i, w in enumerate(items)])
    found = 0
    for i, w in enumerate(items):
        copy = list(w)
        for k in rng.sample(range(40), 40 * percent // 100):
            copy[k] = word()
        text = " ".join([*(word() for _ in range(30)), *copy, *(word() for _ in range(30))])
        own = decontaminate.words(text)[0]
        best = max([decontaminate.align(held.words[j], own[lo:hi][None])[0][0] / 40 for j, lo, hi in decontaminate._passages(own, held, decontaminate.GRAM) if j == i], default=0)
        found += best >= decontaminate.THRESHOLD
    assert found >= 0.9 * len(items)


def test_chains_find_an_edited_passage(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(90)]
    edited = [word() if i % 20 == 10 else w for i, w in enumerate(passage)]
    other = lambda: [word() for _ in range(60)]
    d = spark.createDataFrame([(1, " ".join(other() + passage)), (2, " ".join(other() + edited + other())), (3, " ".join(other()))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in chains.repeated(d).collect()}
    assert got[2]["first_ids"] == [1] and got[2]["n_repeated"] >= 80 and got[1]["n_copies"] == 1 and got[3]["n_passages"] == 0


def _chain_scores(x, y, k=6, cost=0.1, gap=40):
    """Least index of each chain's predecessors, by looking at all pairs."""
    score, back = [k] * len(x), [-1] * len(x)
    for i in range(len(x)):
        near = [(score[j] + cost * (x[j] + y[j]), j) for j in range(i) if 0 < x[i] - x[j] <= gap + k and 0 < y[i] - y[j] <= gap + k]
        if near and (gain := max(near)[0] - cost * (x[i] + y[i] - 2 * k)) > 0:
            score[i], back[i] = k + min(gain, score[max(near)[1]]), max(near)[1]
    return score, back


def test_chain_against_all_pairs():
    rng = random.Random(9)
    for _ in range(200):
        x, y = (list(t) for t in zip(*sorted({(rng.randrange(150), rng.randrange(150)) for _ in range(rng.randrange(1, 90))}), strict=True))
        score, back = _chain_scores(x, y)
        used, want = set(), []
        for i in sorted(range(len(x)), key=lambda i: (-score[i], i)):
            own = []
            while i >= 0 and i not in used:
                used.add(i)
                own.append(i)
                i = back[i]
            if own:
                want.append(own[::-1])
        assert chains.chain(x, y) == want


def test_chains_find_what_follows_a_long_passage(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    some = lambda n: [word() for _ in range(n)]
    a, b, near = some(60), some(60), some(140)
    d = spark.createDataFrame(
        [(1, " ".join(a + some(70) + b)), (2, " ".join(some(20) + a + some(70) + b)), (3, " ".join(near)), (4, " ".join(near[:70] + some(50) + near[70:]))], "doc_id long, text string"
    )
    got = {r["doc_id"]: r for r in chains.repeated(d).collect()}
    assert (got[2]["n_passages"], got[2]["spans"]) == (2, "20:80,150:210")
    assert (got[4]["n_passages"], got[4]["spans"]) == (2, "0:70,120:190")


def test_chains_find_a_passage_whose_parts_stand_in_earlier_documents(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    some = lambda n: [word() for _ in range(n)]
    a, b, c = some(60), some(50), some(55)
    parts = [a[:32] + some(60) + a[28:], some(9) + b[:45], some(9) + b[4:49], some(9) + b[10:], some(8) + c[:40], some(7) + c[15:]]
    later = [some(13) + b + some(20) + a + some(9), some(4) + a + some(30) + b, c + some(30), some(40) + c, some(40) + a + c]
    rows = [(i, " ".join(t)) for i, t in enumerate(parts + later)]
    got = {r["doc_id"]: r["spans"] for r in chains.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    every = {i: t.split() for i, t in rows}
    seen = set()
    for i, t in every.items():
        grams = [tuple(t[k : k + 50]) for k in range(len(t) - 49)]
        held = {w for s in got[i].split(",") if s for w in range(*map(int, s.split(":")))}
        assert {w for k, g in enumerate(grams) if g in seen for w in range(k, k + 50)} <= held
        seen.update(grams)
    assert got[7] and got[9] and got[10]


def test_fingerprint_ranges_by_bisection(spark):
    from bisect import bisect_left

    ids = [*range(-3, 60, 2), None]
    d = spark.createDataFrame([(i,) for i in ids], "x long")
    for n in (0, 1, 2, 3, 9, 10, 17):
        cuts = [3 * i - 2 for i in range(n)]
        got = {r["x"]: r["p"] for r in d.select("x", fingerprints._below(d["x"], cuts).alias("p")).collect()}
        assert all(got[i] == bisect_left(cuts, i) for i in ids if i is not None)


def test_fingerprints(spark, docs):
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(docs, buckets=5).collect()}
    every = texts(docs)
    ids = sorted(every, reverse=True)
    for k, i in enumerate(ids):
        t, after = every[i] or "", every[ids[(k + 1) % len(ids)]] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == __import__("hashlib").sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1 and (edited != t or got[i]["near_edited"] == 1)
    near = [r["near_edited"] - r["near_next"] for r in got.values()]
    assert sum(near) / len(near) > 0.2


def test_warc_by_sql(spark):
    page = "<p>" + "w" * 1200
    rows = [(1, "u", page), (2, "u v", page), (3, None, page), (4, "x", "small"), (5, "x", "small"), (6, "y", None), (6, "y", None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read(warc.write(warc.plan(d))).collect())
    assert got[:3] == [(1, "revisit", 3, 1203), (2, "revisit", 3, 1203), (3, "response", None, 1203)] and all(g[1] == "response" for g in got[3:])


RUNS = {
    "pii": pii.find, "sanitise": pii.sanitise, "langid": lambda d: langid.predict(d, langid.fit(d)), "licenses": licenses.scan, "pieces": pieces.digest, "suffix": suffix_dedup.dedup,
    "join": lambda d: ngram_join.component_ids(d, 5, 80), "one": ngram_join.one_of_each, "prints": lambda d: fingerprints.compare_edited(d, buckets=3), "chains": chains.repeated,
    "leaks": lambda d: decontaminate.clean(d, d.sparkSession.createDataFrame([(1, None), (2, "zeta eta theta iota")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_and_empty_tables(odd, name):
    n = len(RUNS[name](odd).collect())
    assert n == 9 or name == "one" and n == 8  # "ab" and the rest link with nothing
    assert RUNS[name](odd.limit(0)).count() == 0


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, d, SF)
        assert kept.columns == d.columns and kept.count() > 0.8 * d.count(), name


def test_ngram_join_of_a_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    every = {}
    for i in range(400):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(1, 4)):
            w[k] = f"x{rng.randrange(60)}"
        every[i] = w[: rng.randrange(112, 121)]
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, w in every.items()}
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in every.items()], "doc_id long, text string")
    assert len(set(least.values())) > 5 and len(links) > 100
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.component_ids(d, 4, 85).collect()} == least
