"""The registered queries of this subpackage, and their SQL where SQL can express them over whole tables.

Beside the operators' own queries stand three that show the columns of an operator that SQL can give, where it can't give all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clipyard.llm import chains, decontaminate, fingerprints, infill, langid, licenses, ngram_join, pieces, pii, ranked, suffix_dedup, token_counts, warc


def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def license_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op4_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.op8_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


PERSONAL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
  list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM t)
SELECT doc_id, len(email)::BIGINT AS n_email, len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0))::BIGINT AS n_ip,
  len(list_filter(card, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length(x)), lambda i: CASE WHEN i % 2 = 0 THEN x[length(x) - i]::INT WHEN x[length(x) - i]::INT > 4 THEN 2 * x[length(x) - i]::INT - 9 ELSE 2 * x[length(x) - i]::INT END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phone, lambda x: length(x) BETWEEN 9 AND 15))::BIGINT AS n_phone FROM m
"""

_PHRASE = "list_filter(range(0, len(w)), lambda i: w[i + 1:i + {n}] = {words})"
_PLACES = {label: _PHRASE.format(n=len(phrase.split()), words=phrase.split()) for phrase, label in licenses.PHRASES}
LICENSE_WORDS = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, {", ".join(f'{places} AS "{label}"' for label, places in _PLACES.items())} FROM t),
a AS (SELECT *, {" || ".join(f'"{label}"' for label in _PLACES)} AS every FROM p)
SELECT doc_id, len(w)::BIGINT AS n_words, len(every)::BIGINT AS n_base, list_min(every) AS first_word, list_max(every) AS last_word, array_to_string(list_filter([{", ".join(f"CASE WHEN len(\"{label}\") > 0 THEN '{label}' END" for label in sorted(_PLACES))}], lambda x: x IS NOT NULL), ',') AS base_labels FROM a
"""

EDITED = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, length(t) // 2 AS h, coalesce(lead(t) OVER w, first_value(t) OVER w) AS next FROM t WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, n::BIGINT AS n_chars, sha256(substr(t, 1, n - h) || substr(next, 1, h)) AS edited_sha256 FROM n
"""

QUERIES = {f.__name__: f for f in (pii.op1_pii, decontaminate.op2_decontaminate, langid.op3_langid, licenses.op4_licenses, pieces.op5_sentencepiece, suffix_dedup.op6_suffix_dedup, ngram_join.op7_ngram_join, fingerprints.op8_fingerprints, chains.op9_chains, warc.op10_warc, token_counts.op11_token_counts, infill.op12_infill, ranked.op13_ranked_search, personal_data_counts, license_words, edited_texts)}
SQL = {"op6_suffix_dedup": suffix_dedup.ORACLE, "op7_ngram_join": ngram_join.ORACLE, "op10_warc": warc.ORACLE, "op12_infill": infill.ORACLE, "op13_ranked_search": ranked.ORACLE, "personal_data_counts": PERSONAL, "license_words": LICENSE_WORDS, "edited_texts": EDITED}
