"""Licence look-ups: entire texts and lines, never parts."""

import textwrap

from pyspark.sql import functions as F

from shelfcast.llm.licence_texts import TEXTS
from shelfcast.llm.licences import KEPT_LETTERS, KNOWN, SPELLINGS, canonical, scanned


def test_texts_and_lines(spark, awkward, empty):
    mit = TEXTS[0][1]
    texts = {
        1: mit, 2: "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace("  ", " "), 3: mit + " More.", 4: "Some words.\nReleased under the MIT LICENCE\nmore",
        5: "This is Released under the MIT License.", 6: None, 7: "", 8: "Copyright 2001 B", 9: "licensed under cc-by-nc 4.0!\nReleased under the MIT License."}
    rows = [(i, t) for i, t in texts.items()] + [(None, texts[4]), (9, "x")]
    got = [(r["doc_id"], r["license"], r["notices"]) for r in scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, "MIT"), (5, None, ""), (6, None, ""), (7, None, ""), (8, None, ""),
        (9, None, "CC-BY-NC-4.0,MIT"), (None, None, "MIT"), (9, None, "")], key=str)
    assert scanned(awkward).count() == awkward.count()
    assert scanned(empty).count() == 0


def test_known_licences_may_be_given(spark):
    known = spark.createDataFrame([("b", "Do as you like"), ("a", "do as you LIKE."), ("none", "©")], "license string, text string")
    docs = spark.createDataFrame([(1, "do, as you like"), (2, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["license"]) for r in scanned(docs, known).orderBy("doc_id").collect()] == [(1, "a"), (2, None)]


def test_wrapping_does_not_change_what_a_text_is(spark):
    texts = [(name, text) for name, text in KNOWN if len(text) > 100]
    rows = [(f"{name} {width}", "Copyright (c) 2020 A. Person\nCopyright Jane Doe\n" + "\n\n".join(
        textwrap.fill(p, width) for p in text.split("\n\n"))) for name, text in texts for width in (40, 60, 66, 72, 78, 80)]
    got = scanned(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [r["doc_id"] for r in got if r["license"] != r["doc_id"].split()[0]] == []


def test_entire_texts_are_known_under_spellings_and_marks(spark):
    assert {name for name, _ in TEXTS} >= {
        "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Zlib", "BSL-1.0", "Apache-2.0", "MPL-2.0", "GPL-2.0-only",
        "GPL-3.0-or-later", "LGPL-3.0-only", "AGPL-3.0-or-later"}
    odd = lambda text: text.replace("License", "LICENCE").replace("\n\n", "\r\n\r\n  * ").replace("acknowledgment", "Acknowledgement")
    rows = [(f"{i} {name}", "(c) 1999 A\n\u2028 -- " + odd(text)) for i, (name, text) in enumerate(TEXTS)]
    got = scanned(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [r["doc_id"] for r in got if r["license"] != r["doc_id"].split()[1]] == []


def test_leaving_out_by_first_letters_changes_nothing(spark):
    """Against the canonical form of everything; spellings at the very start, breaks of all kinds, short first words."""
    assert KEPT_LETTERS == 3 and all(len(w.split()[0]) >= KEPT_LETTERS for pair in SPELLINGS for w in pair)
    known = [("s", "Sub-license to all"), ("w", "Whilst it lasts"), ("a", "A b c"), ("d", "Per cent of it"), ("n", "1 x"), ("u", "Ünique words")]
    forms = ["sublicense to ALL", "while it lasts", "whilst it lasts!", "a b. c", "a bc", "percent of it", "1-x", "ÜNIQUE words", "sub", "licence"]
    breaks = ["", "Copyright 2000 Me\n", "Copyright 2000 Me\r", "© X\u2028", "--\u0085", "x\n", "Copyright Jane\r\n", "\t* ", "All rights reserved\n\n\n"]
    rows = [(f"{b!r}{f}{e!r}", b + f + e) for b in breaks for f in forms for e in ("", "\nCopyright 3", "\nmore")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    table = spark.createDataFrame(known, "license string, text string")
    form_of = {r["form"]: r["license"] for r in table.select("license", canonical(F.col("text")).alias("form")).collect()}
    whole = {r["doc_id"]: form_of.get(r["form"]) for r in docs.select("doc_id", canonical(F.col("text")).alias("form")).collect()}
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", canonical(F.col("line")).alias("form")).collect()
    notices = {}
    for r in lines:
        notices.setdefault(r["doc_id"], set()).update({form_of[r["form"]]} if r["form"] in form_of else ())
    got = scanned(docs, table).collect()
    assert {r["doc_id"]: (r["license"], r["notices"]) for r in got} == {d: (whole[d], ",".join(sorted(notices[d]))) for d in whole}
    assert sum(r["license"] is not None for r in got) > 40
