"""Operator 4. License scan: ordered signature rules behind a keyword prefilter, in DataFrame functions alone.

Text is lower-cased, words (digits, letters, anything beyond ASCII) are joined by single spaces. Each rule has keywords
of its name and of its form, one of each of which stands in whatever it matches; where a text holds them, the rule's
regular expression runs over all of it. Of two detections one of which lies inside the other, the one of better
priority (at equal priority the longer, then the earlier label) suppresses the other.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipyard.llm.common import table

#: Phrase and label of the base.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, keywords (split by |) one of which every match holds, name as a regular expression over single-spaced words.
FAMILIES = (
    ("mit", "mit", r"mit(?: x11| expat)?"),
    ("mit-0", "mit", r"mit (?:0|no attribution)"),
    ("x11", "x11", r"x11"),
    ("isc", "isc", r"isc"),
    ("0bsd", "bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)"),
    ("bsd-2-clause", "bsd", r"(?:(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two)(?: clause)?)"),
    ("bsd-3-clause", "bsd", r"(?:(?:new|revised|modified|3 clause|three clause) bsd|bsd (?:3|three)(?: clause)?)"),
    ("bsd-4-clause", "bsd", r"(?:(?:original|4 clause|four clause) bsd|bsd (?:4|four)(?: clause)?)"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("apache-1", "apache", r"apache(?: software)?(?: license)?(?: version| v)? ?1(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version| v)? ?1 1"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("apache", "apache", r"apache(?: software)?"),
    ("mpl-1.1", "mpl|mozilla", r"(?:mpl|mozilla public license)(?: version| v)? ?1 1"),
    ("mpl-2", "mpl|mozilla", r"(?:mpl|mozilla public license)(?: version| v)? ?2(?: 0)?"),
    ("epl-1", "epl|eclipse", r"(?:epl|eclipse public license)(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "epl|eclipse", r"(?:epl|eclipse public license)(?: version| v)? ?2(?: 0)?"),
    ("cddl", "cddl|common development", r"(?:cddl|common development and distribution license)(?: version| v)?(?: ?1 [01])?"),
    ("eupl", "eupl|european union", r"(?:eupl|european union public licen[cs]e)(?: version| v)?(?: ?1 [0-2])?"),
    ("artistic-2", "artistic", r"artistic(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("artistic", "artistic", r"artistic"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng", r"libpng"),
    ("boost", "bsl|boost", r"(?:bsl|boost(?: software)?)(?: license)?(?: version| v)?(?: ?1 0)?"),
    ("python", "psf|python", r"(?:psf|python software foundation)(?: license)?(?: version| v)?(?: ?2)?"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("openssl", "openssl", r"openssl"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version| v)?(?: ?2)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("ofl", "ofl|open font", r"(?:ofl|(?:sil )?open font license)(?: version| v)?(?: ?1 [01])?"),
    ("odbl", "odbl|database", r"(?:odbl|open (?:data commons open )?database license)(?: version| v)?(?: ?1 0)?"),
    ("odc-by", "odc by|open data commons", r"(?:odc by|open data commons attribution license)"),
    ("pddl", "pddl|public domain", r"(?:pddl|public domain dedication and license)"),
    ("cc0", "cc0|cc zero|commons zero", r"(?:cc0|cc zero|creative commons zero)(?: ?1 0)?(?: universal)?"),
    ("bsl-1.1", "busl|business source", r"(?:busl|business source license)(?: ?1 1)?"),
    ("sspl", "sspl|server side", r"(?:sspl|server side public license)(?: version| v)?(?: ?1)?"),
    ("elastic", "elastic", r"elastic(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("openrail", "rail|responsible ai", r"(?:open ?rail(?: m)?|responsible ai)"),
)
#: name, its words, versions and keywords of the copyleft families.
COPYLEFT = (("gpl", r"(?:gnu )?(?:gpl|general public licen[cs]e)", ("1", "2", "3"), "gpl|general public"), ("lgpl", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e)", ("2", "2 1", "3"), "lgpl|lesser|library"), ("agpl", r"(?:gnu )?(?:agpl|affero general public licen[cs]e)", ("1", "3"), "agpl|affero"), ("gfdl", r"(?:gnu )?(?:gfdl|fdl|free documentation licen[cs]e)", ("1 1", "1 2", "1 3"), "fdl|free documentation"))
#: Creative Commons: short form, long form; each with versions.
COMMONS = (("cc-by", "cc by", "attribution"), ("cc-by-sa", "cc by sa", "attribution share ?alike"), ("cc-by-nd", "cc by nd", "attribution no ?deriv[a-z]*"), ("cc-by-nc", "cc by nc", "attribution non ?commercial"), ("cc-by-nc-sa", "cc by nc sa", "attribution non ?commercial share ?alike"), ("cc-by-nc-nd", "cc by nc nd", "attribution non ?commercial no ?deriv[a-z]*"))
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Ways to name a license: form, its keyword, priority (less is better), weight. X stands for the name.
FORMS = (
    (r"spdx license identifier X\b", "spdx license identifier", 1, 1.0),
    (r"(?:licensed|released|distributed|available|published|provided|shared) under (?:the )?(?:terms of )?(?:the )?X(?: licen[cs]e)?\b", "ed under|available under", 2, 0.95),
    (r"under (?:the )?(?:terms of )?(?:the )?X(?: licen[cs]e)\b", "under", 3, 0.9),
    (r"licen[cs]e[sd]? (?:is |as |type )?(?:the )?X\b", "licen", 4, 0.8),
    (r"\bX licen[cs]e\b", "licen", 5, 0.75),
)
#: Sentences of well-known texts and notices: label, keyword, expression over single-spaced words.
TEXTS = (
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy(?! of this software)"),
    ("mit", "substantial portions", r"(?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "without restriction", r"deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("isc", "permission to use", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "permission to use", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("isc", "permission to use", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee(?! is hereby granted)"),
    ("hpnd", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("postgresql", "written agreement", r"for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of .{0,200}?may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-clear", "express or implied licenses", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-2", "apache org", r"(?:www )?apache org licenses license 2 0"),
    ("apache-2", "apache license", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "apache license", r"apache license version 2 0 january 2004"),
    ("llvm-exception", "llvm exception", r"(?:with|and) (?:the )?llvm exceptions?"),
    ("gpl", "gnu org", r"(?:www )?gnu org licenses(?: gpl)?"),
    ("gpl-1-or-later", "redistribute it", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 1(?: of the license)? or at your option any later version"),
    ("gpl-2-or-later", "redistribute it", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2(?: of the license)? or at your option any later version"),
    ("gpl-3-or-later", "redistribute it", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version"),
    ("gpl-2", "redistribute it", r"redistribute it and or modify it under the terms of (?:version 2 of )?the gnu general public license(?: version 2)? (?:as published by the free software foundation )?version 2"),
    ("gpl", "redistribute it", r"redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl-2.1-or-later", "redistribute it", r"redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1(?: of the license)? or at your option any later version"),
    ("lgpl-3-or-later", "redistribute it", r"redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version"),
    ("lgpl-2-or-later", "redistribute it", r"redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2(?: of the license)? or at your option any later version"),
    ("lgpl", "redistribute it", r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl-3-or-later", "redistribute it", r"redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version"),
    ("agpl", "redistribute it", r"redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "general public license along with", r"you should have received a copy of the gnu general public license along with"),
    ("lgpl", "general public license along with", r"you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("agpl", "general public license along with", r"you should have received a copy of the gnu affero general public license along with"),
    ("gpl", "everyone is permitted", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gfdl", "copy distribute and or modify", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl-classpath-exception", "classpath exception", r"(?:with|and) (?:the )?classpath exception"),
    ("gpl-linking-exception", "special exception", r"as a special exception the copyright holders (?:of this library )?give you permission to link"),
    ("mpl-1.1", "mozilla public license", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", "mozilla public license", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("mpl", "mozilla org", r"(?:www )?mozilla org mpl"),
    ("epl-1", "eclipse public license", r"made available under the terms of the eclipse public license v(?:ersion)? 1 0"),
    ("epl-2", "eclipse public license", r"made available under the terms of the eclipse public license (?:v(?:ersion)? )?2 0"),
    ("epl", "eclipse org", r"(?:www )?eclipse org legal epl"),
    ("cddl", "common development and distribution", r"subject to the terms of the common development and distribution license"),
    ("cpl-1", "common public license", r"(?:under the terms of )?the common public license(?: v(?:ersion)?)? 1 0"),
    ("ms-pl", "microsoft public license", r"microsoft public license(?: ms pl)?"),
    ("ms-rl", "microsoft reciprocal license", r"microsoft reciprocal license(?: ms rl)?"),
    ("artistic", "artistic license", r"under the (?:same )?terms (?:of|as) (?:the )?(?:perl )?artistic license"),
    ("perl", "same terms as perl", r"under the same terms as perl(?: itself)?"),
    ("ruby", "same terms as ruby", r"under the same terms as ruby(?: itself)?"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("boost", "boost software license", r"distributed under the boost software license version 1 0"),
    ("ncsa", "deal with the software", r"to deal with the software without restriction"),
    ("openssl", "openssl toolkit", r"developed by the openssl project for use in the openssl toolkit"),
    ("ofl", "open font license", r"this font software is licensed under the sil open font license version 1 1"),
    ("python", "python software foundation", r"python software foundation license version 2"),
    ("php-3.01", "php license", r"subject to version 3 01? of the php license"),
    ("w3c", "w3c software", r"w3c software (?:notice and|and document) license"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("wtfpl", "what the", r"do what the f[a-z]{3} you want to(?: public license)?"),
    ("unlicense", "public domain", r"free and unencumbered software released into the public domain"),
    ("cc0", "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("cc0", "creativecommons org", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc(?! (?:sa|nd))(?: [1-4] [05])?"),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by(?! (?:nc|nd|sa))(?: [1-4] [05])?"),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain"),
    ("public-domain", "no copyright is claimed", r"no copyright is claimed"),
    ("no-derivatives", "no derivative works", r"no derivative works (?:are )?(?:permitted|allowed)"),
    ("non-commercial", "commercial use", r"(?:for )?non ?commercial use only|commercial use is (?:not permitted|prohibited|forbidden)|not for commercial use"),
    ("research-only", "research", r"(?:for )?(?:academic (?:and|or) )?research (?:purposes|use) only"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "strictly prohibited", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)[a-z ]{0,120}is strictly prohibited"),
    ("proprietary", "may be reproduced", r"no part of this (?:publication|work|document|book) may be reproduced"),
    ("proprietary", "written permission", r"without (?:the )?(?:express |prior )*written permission of"),
    ("all-rights-reserved", "all rights", r"all rights (?:are )?reserved"),
    ("dual", "dual licensed", r"dual licensed under"),
)
#: One of these stands in every match: keywords of the forms and of TEXTS.
GATE = ("licen", *(f"{w} under" for w in ("released", "distributed", "available", "published", "provided", "shared")), *dict.fromkeys(key for _, key, _ in TEXTS))


def rules() -> list[dict]:
    """The ordered rules: every family and version in every form, then whole sentences. Priority: a versioned or longer name before the bare one, then the form."""
    names = [(label, key, name, 0 if any(ch.isdigit() for ch in label) else 1) for label, key, name in FAMILIES]
    for short, words, versions, key in COPYLEFT:
        names += [(f"{short}-{v.replace(' ', '.')}" + plus, key, rf"{words}(?: version| v)? ?{v}(?: 0)?{tail}", rank) for v in versions for plus, tail, rank in (("-or-later", r"(?: or(?: \(at your option\))?(?: any)? later(?: version)?| plus)", 0), ("", "", 1))]
        names.append((short, key, words, 2))
    for label, short, long in COMMONS:
        name = rf"(?:{short}|(?:creative commons )?{long})"
        names += [(f"{label}-{v.replace(' ', '.')}", f"{short}|attribution", rf"{name} {v}(?: international| unported)?", 0) for v in COMMONS_VERSIONS]
        names.append((label, f"{short}|attribution", name, 1))
    out = [{"label": label, "keys": key.split("|"), "form": held.split("|"), "regex": form.replace("X", name), "rank": 10 * rank + order, "weight": weight} for label, key, name, rank in names for form, held, order, weight in FORMS]
    out += [{"label": label, "keys": [key], "form": [""], "regex": expr, "rank": 6, "weight": 0.85} for label, key, expr in TEXTS]
    return out


def _words(text: Column) -> Column:
    """The words of lower-cased text, joined by single spaces. lower() differs from A-Z alone only in words that no phrase holds."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _n_words(words: Column) -> Column:
    return F.when(words == "", F.lit(0)).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("long")


def _places(spaced: Column, words: Column, n: Column, phrase: str) -> dict[str, Column]:
    """Count, first and last start of a phrase; in `spaced` each word has spaces of its own on both sides."""
    sought = " " + "  ".join(phrase.split()) + " "
    before = lambda x: ((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) / 2).cast("long")
    count = ((F.length(spaced) - F.length(F.replace(spaced, F.lit(sought), F.lit("")))) / len(sought)).cast("long")
    found = F.contains(words, F.lit(phrase)) & F.contains(spaced, F.lit(sought))
    return {
        "n": F.when(found, count).otherwise(F.lit(0).cast("long")),
        "first": F.when(found, before(F.substring_index(spaced, sought, 1))),
        "last": F.when(found, n - len(phrase.split()) - before(F.substring_index(spaced, sought, -1))),
    }


def _detections(words: Column, held: Column) -> Column:
    """Every match of every rule whose keywords the text holds, by start."""
    any_of = lambda keys: F.exists(keys, lambda k: F.contains(words, k))
    ran = F.transform(F.filter(held, lambda r: any_of(r["form"]) & any_of(r["keys"])), lambda r: F.struct(r.alias("r"), F.regexp_extract_all(words, r["regex"], F.lit(0)).alias("found")))
    with_gaps = F.transform(F.filter(ran, lambda x: F.size(x["found"]) > 0), lambda x: F.struct(x["r"].alias("r"), x["found"].alias("found"), F.transform(F.split(words, x["r"]["regex"]), F.length).alias("gaps")))

    def placed(x: Column) -> Column:
        r, none = x["r"], F.array().cast("array<struct<start:int,size:int,label:string,rank:int,weight:double>>")
        begin = F.struct(F.lit(1).alias("at"), none.alias("out"))

        def step(acc: Column, m: Column) -> Column:
            start, size = acc["at"] + m["gap"], F.length(m["text"])
            one = F.struct(start.alias("start"), size.alias("size"), r["label"].alias("label"), r["rank"].alias("rank"), r["weight"].alias("weight"))
            return F.struct((start + size).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        each = F.zip_with(x["found"], F.slice(x["gaps"], 1, F.size(x["found"])), lambda t, g: F.struct(t.alias("text"), g.alias("gap")))
        return F.aggregate(each, begin, step, lambda acc: acc["out"])

    return F.array_sort(F.flatten(F.transform(with_gaps, placed)))


def _clusters(found: Column) -> Column:
    """Detections by start, cut where none reaches across."""
    kind = "array<struct<start:int,size:int,label:string,rank:int,weight:double>>"
    begin = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.array().cast(kind).alias("own"), F.lit(0).alias("end"))

    def step(acc: Column, m: Column) -> Column:
        apart, end = m["start"] >= acc["end"], m["start"] + m["size"]
        return F.struct(
            F.when(apart, F.concat(acc["done"], F.array(acc["own"]))).otherwise(acc["done"]).alias("done"),
            F.when(apart, F.array(m)).otherwise(F.concat(acc["own"], F.array(m))).alias("own"),
            F.greatest(acc["end"], end).alias("end"),
        )

    return F.aggregate(found, begin, step, lambda acc: F.concat(acc["done"], F.array(acc["own"])))


def _kept(found: Column) -> Column:
    """Detections, the better ones first, that contain no better one that is kept and lie in none; better: less rank, then longer, then the earlier label. One that is itself suppressed suppresses nothing."""
    inside = lambda o, m: (o["start"] <= m["start"]) & (o["start"] + o["size"] >= m["start"] + m["size"])
    in_order = F.array_sort(F.transform(found, lambda m: F.struct(m["rank"].alias("rank"), (-m["size"]).alias("less"), m["label"].alias("label"), m["start"].alias("start"), m.alias("m"))))
    none = F.filter(found, lambda m: F.lit(False))
    kept = F.aggregate(in_order, none, lambda acc, x: F.when(F.exists(acc, lambda o: inside(o, x["m"]) | inside(x["m"], o)), acc).otherwise(F.concat(acc, F.array(x["m"]))))
    return F.when(F.size(found) > 1, kept).otherwise(found)


def scan(docs: DataFrame) -> DataFrame:
    """docs plus n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text is empty: 0 words, no labels, score 0. Rows are independent, so copies and ties need no rule; other
    columns pass through. A column that has the name of a result is replaced.
    """
    schema = "array<struct<label:string,keys:array<string>,form:array<string>,regex:string,rank:int,weight:double>>"
    held = F.from_json(F.lit(json.dumps(rules())), schema)
    words = F.col("clipyard_words")
    df = docs.withColumn("clipyard_words", _words(F.col("text")))
    df = df.withColumn("n_words", _n_words(words))
    base = F.lit(False)
    for phrase, _ in PHRASES:
        base = base | F.contains(words, F.lit(phrase))
    df = df.withColumn("clipyard_spaced", F.when(base, F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))))
    each = {label: _places(F.col("clipyard_spaced"), words, F.col("n_words"), phrase) for phrase, label in PHRASES}
    df = df.withColumn("n_base", sum((x["n"] for x in each.values()), F.lit(0).cast("long")))
    df = df.withColumn("first_word", F.least(*(x["first"] for x in each.values()))).withColumn("last_word", F.greatest(*(x["last"] for x in each.values())))
    df = df.withColumn("clipyard_base", F.array_sort(F.array_compact(F.array(*(F.when(x["n"] > 0, F.lit(label)) for label, x in each.items())))))
    gate = F.lit(False)
    for word in GATE:
        gate = gate | F.contains(words, F.lit(word))
    kind = "array<struct<start:int,size:int,label:string,rank:int,weight:double>>"
    df = df.withColumn("clipyard_all", F.when(gate, _detections(words, held)).otherwise(F.array().cast(kind)))
    found = F.when(F.size("clipyard_all") > 0, F.flatten(F.transform(_clusters(F.col("clipyard_all")), _kept))).otherwise(F.array().cast(kind))
    df = df.withColumn("clipyard_found", found)
    labels = F.array_sort(F.array_distinct(F.concat(F.col("clipyard_base"), F.transform("clipyard_found", lambda m: m["label"]))))
    best = F.coalesce(F.array_max(F.transform("clipyard_found", lambda m: m["weight"])), F.lit(0.0))
    df = df.withColumn("base_labels", F.array_join("clipyard_base", ",")).withColumn("labels", F.array_join(labels, ","))
    df = df.withColumn("score", F.greatest(best, F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0))))
    return df.drop("clipyard_words", "clipyard_spaced", "clipyard_base", "clipyard_all", "clipyard_found")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

