import random
import re

import pytest

from shelfcast.llm import sanitise
from shelfcast.llm.sanitise import (
    CONTEXTS, _cleaned, base_spans, disclosing, luhn, neighbourhoods, op12_disclosing_terms, profiled, sanitised, scanned)

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
CARD = "4539 1488 0343 6467"


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            keep = [True, all(int(p) <= 255 for p in m.group().split(".") if kind == 1), 14 <= len(digits) <= 19 and luhn(digits),
                    10 <= len(digits) <= 15][kind]
            if keep:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["a.@-_ ", "19.@ ", "+1 ()-.", "4539148803436467 -", "0a1.@+ é-(_%"])
def test_base_spans_equal_the_plain_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 5, 20, 60])))
        assert base_spans(text) == plain_spans(text), text


def test_planted_values_in_a_long_text():
    text = "é " * 50 + f"Jo.Do@mail.example.org, 10.0.0.255 256.1.1.1, {CARD} +44 20 7946 0958"
    assert [(k, text[a:b]) for a, k, b in base_spans(text)] == [
        (0, "Jo.Do@mail.example.org"), (1, "10.0.0.255"), (2, CARD), (3, "+44 20 7946 0958")]


def test_long_runs_take_linear_time():
    for text in ("1" * 300000, "a" * 300000, "a@" * 100000, "1.1." * 60000, "+1" * 100000, "1 " * 100000, "-" * 300000 + "@"):
        base_spans(text)


def corpus():
    """An address whose company word stands near it in different texts, and hardly elsewhere."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{filler(30)} Quixotal the {filler(1)} jo@quix.example {filler(20)}") for i in range(6)]
    rows += [(100 + i, f"the {filler(60)}") for i in range(100)]
    rows += [(300, f"{filler(9)} quixotal, without the address {filler(9)}"), (301, "quiz quixote quilt quip quietly quit"),
             *[(310 + i, "quiz quixote quilt quip quietly quit " * 5) for i in range(3)]]
    # A rare word beside an address in copies of one text has one witness only.
    rows += [(400 + i, "alone zanzibar sees al@other.example here") for i in range(9)]
    return rows


def test_a_disclosing_term_is_found_everywhere_and_generalised(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    found = {r["term"]: r["replacement"] for r in disclosing(docs, profiled(docs))[0].collect()}
    assert found["quixotal"] == "qui*" and "the" not in found and "zanzibar" not in found
    spans = {r["doc_id"]: r for r in scanned(docs).collect()}
    text = dict(corpus())
    extra = [text[300][s["start"]:s["end"]] for s in spans[300]["extra"]]
    assert "quixotal" in extra and not spans[300]["base"]
    clean = {r["doc_id"]: r["text"] for r in sanitised(docs).collect()}
    assert "[EMAIL]" in clean[0] and "qui*" in clean[0] and "jo@" not in clean[0]
    assert clean[301] == text[301] and "zanzibar sees [EMAIL]" in clean[400]


def brute_disclosing(rows):
    """The statistics in plain loops: the disclosing terms."""
    from collections import Counter, defaultdict
    from math import log2

    from shelfcast.llm.sanitise import THRESHOLD, TERM
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, near, size, seen = Counter(), Counter(), Counter(), defaultdict(set)
    for _, text in rows:
        n.update(w.translate(lower) for w in re.findall(TERM, text or ""))
        for c, held in neighbourhoods(text or "", base_spans(text or "")):
            size[c] += len(held)
            for t in held:
                near[c, t] += 1
                seen[c, t].add(" ".join(held))
    total = sum(n.values())
    return {t for (c, t), k in near.items() if len(seen[c, t]) >= CONTEXTS
            and log2(min(k / n[t], 1) / (size[c] / total)) / -log2(size[c] / total) >= THRESHOLD}


def test_statistics_equal_plain_loops(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["term"] for r in disclosing(docs, profiled(docs))[0].collect()} == brute_disclosing(rows)


def test_what_is_written_grows_with_terms_and_not_with_texts(spark, monkeypatch):
    made, written = {}, sanitise.written

    def counted(df, name, *by):
        out = written(df, name, *by)
        made[name] = out.count()
        return out

    monkeypatch.setattr(sanitise, "written", counted)
    # A word near the address is in every other text too, in new ones as in old ones.
    rows, common = corpus(), "the " + " ".join(f"w{i}" for i in range(500))
    sizes = []
    for texts in (20, 200):
        docs = spark.createDataFrame([*rows, *[(1000 + i, common) for i in range(texts)]], "doc_id long, text string").repartition(4)
        disclosing(docs, profiled(docs))
        sizes.append(sum(n for name, n in made.items() if name not in ("personal-data", "hits")))
    assert sizes[1] <= sizes[0] + 50


def test_spans_are_the_same_whichever_join_is_picked(spark, monkeypatch):
    rows = [*corpus(), *corpus()[:3], (None, corpus()[0][1]), (500, None), (501, "QUIXOTAL \u00c9t\u00e9 quixotal"), (502, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = sorted(map(str, scanned(docs).collect()))
    assert len(expected) == len(rows) and any("kind=4" in r for r in expected)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(sanitise, "CODES", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, scanned(docs).collect())) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_neighbourhoods_leave_out_other_base_spans():
    text = "one two me@x.org three 10.0.0.1 four"
    assert neighbourhoods(text, base_spans(text)) == [
        ("email:me@x.org", ["one", "two", "three", "four"]), ("ip:10.0.0.1", ["one", "two", "three", "four"])]


def test_overlapping_kinds_are_written_once():
    text = f"call +{CARD.replace(' ', '')} now"
    assert _cleaned(text, []).count("[") == 1
    assert _cleaned("", []) == "" and _cleaned("plain", []) == "plain"


def test_awkward_documents(spark, awkward, empty):
    assert scanned(awkward).count() == awkward.count() and scanned(empty).count() == 0
    assert sorted(map(str, sanitised(awkward).collect())) == sorted(map(str, awkward.collect()))
    assert sanitised(empty).columns == empty.columns


def test_query_columns(spark):
    made = op12_disclosing_terms(spark, "/root/testdata/sf0.001")
    assert made.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert made.filter("spans <> ''").count() > 0
