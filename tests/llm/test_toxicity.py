"""Toxicity: the automaton against edit distances, context, held-out accuracy, awkward rows."""

import pandas as pd
from hypothesis import given, settings, strategies as st

from shelfcast.llm.lexicon import STEM, WORD, LexiconAutomaton, WordMatches, allowed_errors
from shelfcast.llm.toxicity import N_FEATURES, clean, fitted, learned_lexicon, op3_lexicon_automata, scored, text_features

SF = "/root/testdata/sf0.01"
ENTRIES = [("idiot", WORD, 5.0), ("scum", WORD, 4.5), ("worthless", WORD, 4.0), ("achlich", STEM, 3.0), ("idiots", WORD, 3.5)]


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("idotscumwrhle", max_size=11), st.sampled_from(["idiot", "idiott", "dio", "scums", "wrthles", "achlichx", "idots", "worthlezz"])))
def test_automaton_accepts_exactly_the_words_within_the_edits(word):
    got = LexiconAutomaton(ENTRIES).match(word)
    near = [(distance(word, t), w) for t, kind, w in ENTRIES if kind == WORD and distance(word, t) <= allowed_errors(t)]
    stems = [(0, w) for t, kind, w in ENTRIES if kind == STEM and word.startswith(t)]
    want = max(((d == 0, w) for d, w in near + stems), default=None)
    assert got == (None if want is None else (want[1], want[0]))


def test_context_parts_quotation_from_abuse():
    matches = WordMatches(LexiconAutomaton(ENTRIES))
    abuse, quoted = text_features("you are an idiot today", matches), text_features('they said "idiot" to all', matches)
    assert abuse[0] > 0 and abuse[8] == 0
    assert quoted[0] == 0 and quoted[8] > 0
    assert text_features("a worthles thing", matches)[6] > 0
    assert text_features(None, matches) == text_features("", matches) == [0.0] * N_FEATURES


def test_every_run_of_letters_is_a_word():
    matches = WordMatches(LexiconAutomaton(ENTRIES))
    joined, apart = text_features("idiot,scum/worthless_idiot", matches), text_features("idiot scum worthless idiot", matches)
    assert joined == apart and joined[0] == text_features("idiot " * 4, matches)[0]
    assert text_features('"idiot/scum"', matches)[8] == text_features('"idiot" "scum"', matches)[8] > 0


def test_no_rank_drops_learned_terms(spark):
    names = ["".join(chr(97 + (i // 26 ** k) % 26) for k in range(3)) for i in range(2600)]
    rows = [(" ".join(names) if i % 2 else "plain words here", i % 2) for i in range(80)]
    entries = learned_lexicon(spark.createDataFrame(rows, "text string, label int"))
    assert {e[0] for e in entries if e[1] == WORD} >= set(names)


def test_held_out_accuracy(spark):
    got = op3_lexicon_automata(spark, SF).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    told = got.merge(pd.read_parquet(SF + "/labels.parquet"), on="doc_id")
    held = told[told.held_out]
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.9
    assert held[held.toxic == 1].score.mean() > 0.5 > 0.1 > held[held.toxic == 0].score.mean()


def test_awkward_rows_keep_their_columns(spark, awkward, empty):
    labels = spark.createDataFrame(
        [(i, i % 3 == 0 and 1 or 0) for i in range(60)] + [(None, 1), (0, 0), (1, None), (999, 1)], "doc_id long, toxic int")
    model = fitted(awkward, labels)
    rows = scored(awkward, model)
    assert sorted(rows.columns) == sorted(awkward.columns)
    assert rows.count() == awkward.count() and rows.filter("score between 0 and 1").count() == awkward.count()
    assert clean(awkward, labels).columns == awkward.columns
    assert scored(empty, model).count() == 0
    none = fitted(awkward, labels.limit(0))
    assert scored(awkward, none).filter("score = 0.5").count() == awkward.count()
    assert {r["score"] > 0.9 for r in scored(awkward, fitted(awkward, labels.filter("toxic = 1"))).collect()} == {True}
