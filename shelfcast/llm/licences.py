"""Licence scans by canonical digest.

A text is brought to a canonical form (lower case, copyright lines dropped, punctuation and
white space as one space, equivalent spellings as one) and its digest is hash-joined to the
digests of known licences. A match is of an entire text: the whole document, or one whole line
of it, which is how notices are set. Nothing is matched in part.

Nulls and edge cases: a null or empty text, or one that is only copyright lines, has no
licence; a null id is kept; equal texts get equal results and are looked up by their content,
so ids may repeat; a table of known licences that lists a text twice gives the first by name;
no rows give no rows. Other columns are not carried.

What cannot be a known licence is not brought to its form. Equivalent spellings begin with the
same letters, so the first letters of a form are those of the first word that no copyright line
holds, and that word begins a line: texts and lines of which no line begins as a known form does
are left out, which changes no result.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfcast.functions.tables import written
from shelfcast.llm.common import table
from shelfcast.llm.licence_texts import TEXTS

# Spellings held to be the same, after punctuation is gone.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("behaviour", "behavior"), ("copyright holder", "copyright owner"), ("favour", "favor"),
    ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"),
    ("licencing", "licensing"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("per cent", "percent"), ("programme", "program"), ("recognised", "recognized"),
    ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("https", "http"),
)
# How many letters at the start of a spelling both forms share; each begins with a word at least as long.
KEPT_LETTERS = min(len(os.path.commonprefix(pair)) for pair in SPELLINGS)
# Words after "copyright" or "(c)" in the prose of a licence; anything else is a name, a year or a sign.
PROSE = (
    "notice", "notices", "holder", "holders", "owner", "owners", "license", "licenses", "licence", "licences", "law", "laws",
    "and", "or", "in", "of", "to", "for", "is", "interest", "interests", "protection", "statement", "statements", "patent",
    "trademark", "treaty", "disclaimer", "you")


def _other_word(words: tuple[str, ...]) -> str:
    """A pattern of the words that are none of these, letter by letter: the oracle's engine has no look-ahead."""
    heads = sorted({w[0] for w in words if w})
    if not heads:
        return r"[\p{L}\p{N}]+"
    ways = [rf"[^\P{{L}}{''.join(heads)}][\p{{L}}\p{{N}}]*", r"\p{N}[\p{L}\p{N}]*"]
    ways += [h + _other_word(tuple(w[1:] for w in words if w[:1] == h)) for h in heads]
    return f"(?:{'|'.join(ways)}{'' if '' in words else '|'})"


_NAMED = rf"[^\p{{L}}\p{{N}}\n]+{_other_word((*PROSE, ''))}(?:[^\p{{L}}\p{{N}}\n][^\n]*)?"
COPYRIGHT_LINE = (
    rf"(?m)^[^\p{{L}}\p{{N}}\n]*(?:(?:copyright|\(c\)){_NAMED}|copyright[^\p{{L}}\p{{N}}\n]*(?:©|\p{{N}})[^\n]*"
    r"|(?:©|all rights reserved)[^\n]*)$")

# The notices that stand for a licence, after its entire texts. More licences come
# in as a table of (license, text) of the same shape.
KNOWN = (
    *TEXTS,
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This work is licensed under the GNU General Public License, version 3 or later."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)


def canonical(text: Column) -> Column:
    """The form two texts of one licence share; empty for a text without content."""
    plain = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    plain = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
    for given, kept in SPELLINGS:
        plain = F.replace(plain, F.lit(given), F.lit(kept))
    return plain


def first_letters(form: Column) -> Column:
    """The letters of a canonical form's first word that no spelling changes."""
    return F.substring(F.element_at(F.split(form, " "), 1), 1, KEPT_LETTERS)


def may_be_known(text: Column, letters: list[str]) -> Column:
    """Whether a line of the text begins with the first letters of a known form."""
    if not letters:
        return F.lit(False)
    return F.lower(text).rlike(rf"(?m)^[^\p{{L}}\p{{N}}\n\r\u0085\u2028\u2029]*+(?:{'|'.join(sorted(letters))})")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license, letters), one row per digest."""
    texts = spark.createDataFrame(list(KNOWN), "license string, text string") if known is None else known
    forms = texts.select("license", canonical(F.col("text")).alias("form")).filter(F.length("form") > 0)
    return (
        forms.groupBy(F.sha2("form", 256).alias("digest"), first_letters(F.col("form")).alias("letters"))
        .agg(F.min("license").alias("license")))


def scanned(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, notices): the licence a document is, and those its lines name."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table_of = written(known_digests(spark, known), "licences")
    # Three letters each, of the known licences alone.
    letters = [r["letters"] for r in table_of.select("letters").distinct().collect()]
    table_of = table_of.drop("letters")
    content = F.sha2(F.col("text"), 256)
    lines = docs.select(content.alias("content"), F.explode(F.split("text", "\n")).alias("line"))
    named = (
        lines.filter(may_be_known(F.col("line"), letters)).withColumn("digest", digest(F.col("line"))).join(table_of, "digest")
        .groupBy("content").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices")))
    # Texts with a notice; written, so that Spark can weigh the join by its size.
    named = written(named, "notices")
    form = F.when(may_be_known(F.col("text"), letters), digest(F.col("text")))
    whole = docs.select("doc_id", content.alias("content"), form.alias("digest"))
    return (
        whole.join(table_of, "digest", "left").join(named, "content", "left")
        .select("doc_id", "license", F.coalesce("notices", F.lit("")).alias("notices")))


def op6_licences(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    sql = (rf"trim(regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))")
    for given, kept in SPELLINGS:
        sql = f"replace({sql}, '{given}', '{kept}')"
    return sql


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = f"""
WITH known AS (
  SELECT {_sql_canonical("text")} AS form, min(license) AS license
  FROM (VALUES {", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in KNOWN)}) AS k(license, text) GROUP BY form),
docs AS (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents),
lines AS (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM docs),
named AS (
  SELECT row_no, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT row_no, {_sql_canonical("line")} AS form FROM lines) JOIN known USING (form) WHERE form <> '' GROUP BY row_no),
whole AS (
  SELECT row_no, license FROM (SELECT row_no, {_sql_canonical("text")} AS form FROM docs) JOIN known USING (form) WHERE form <> '')
SELECT doc_id, license, coalesce(notices, '') AS notices
FROM docs LEFT JOIN whole USING (row_no) LEFT JOIN named USING (row_no)
"""
