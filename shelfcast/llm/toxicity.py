"""Toxicity by a learned lexicon, misspellings included, read in context.

* The lexicon is learned from labelled documents: words, and stems of words, that stand in far
  more toxic texts than others. The weights of the score are fitted on features from a lexicon
  of the other half of the sample, so that the score has seen how lexicons do on new texts.
* Levenshtein automata intersected with the lexicon's trie find its words with one or two
  letters wrong.
* A window of words around each match tells quotation (between quote marks, or next to a word
  of reporting) from abuse; the two are counted apart.

The score is a logistic regression on the counts. The sample is bounded (`SAMPLE`); every whole
text is scored. Labels, language, source and id are never inputs of a score.

Nulls and edge cases: a null text is an empty one and gets the score of a text without
matches; a null id is not held out; rows may repeat; without labelled rows of both kinds the
score says what kind there was, or 0.5; no rows give no rows. All columns pass through, and
`score` is added (replaced if there).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shelfcast.functions.shipping import shipped
from shelfcast.functions.tables import written
from shelfcast.llm.common import fresh, table
from shelfcast.llm.labels import held_out, logistic, training_sample
from shelfcast.llm.lexicon import LETTERS, STEM, WORD, LexiconAutomaton, WordMatches

FOLDS, HELD_FOLD, CUT = 4, 2, 0.3
# Documents the lexicon and the weights are fitted on, at most.
SAMPLE = 8000
LEAST_TEXTS = 3
LEAST_WEIGHT = 1.5
STEM_LENGTHS = range(4, 11)
WINDOW = 6
# Marks of quotation and words that report what others said.
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset(
    "said says say called calls wrote writes quoted quote quotes quoting word words term slur reported reports "
    "sagte sagt schrieb nannte zitat wort dit disait écrit appelé mot citation dijo dice escribió llamó palabra cita".split())
STRENGTHS = (4.0, 2.5, 0.0)


def _terms(text: str) -> set[str]:
    """Words (ending in a blank) and stems of a text."""
    words = set(LETTERS.findall(text.lower()))
    return {w + " " for w in words if len(w) > 2} | {w[:n] for w in words for n in STEM_LENGTHS if n < len(w)}


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            counts[label].update(_terms(text))
        # A term of no toxic text never enters the lexicon, but one task cannot know that.
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({
            "term": terms, "clean": pa.array([counts[0][t] for t in terms], pa.int64()),
            "toxic": pa.array([counts[1][t] for t in terms], pa.int64())})


def learned_lexicon(sample: DataFrame) -> list[tuple[str, str, float]]:
    """(term, kind, log-odds of a toxic text) of every term that the sample is evidence for.

    No rank decides: the evidence asked for grows with the number of terms, so that chance alone lets about
    one through. Evidence needs texts, so the terms are bounded by the words of the sample's toxic texts.
    """
    texts = {int(r["label"]): r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(texts) < 2:
        return []
    odds = F.log((F.col("toxic") + 0.5) / (texts[1] + 1)) - F.log((F.col("clean") + 0.5) / (texts[0] + 1))
    # Twice the log-likelihood ratio against a term that is as common in both kinds of text.
    both, everything = F.col("toxic") + F.col("clean"), texts[0] + texts[1]
    part = lambda n, kind: F.when(n > 0, n * F.log(n * everything / (both * texts[kind]))).otherwise(0.0)
    evidence = 2 * (part(F.col("toxic"), 1) + part(F.col("clean"), 0))
    every = written(
        sample.select("text", "label").mapInArrow(_term_counts, "term string, clean long, toxic long")
        .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "terms")
    # With so many terms, chance alone would show about one beyond this.
    needed = 2 * math.log(max(every.count(), 1))
    counted = (
        every.filter(F.col("toxic") >= LEAST_TEXTS).withColumn("weight", odds)
        .filter((F.col("weight") >= LEAST_WEIGHT) & (evidence >= needed)))
    best = counted.orderBy("term").collect()
    stems = {r["term"]: r["weight"] for r in best if not r["term"].endswith(" ")}
    words = {r["term"][:-1]: (r["weight"], r["toxic"]) for r in best if r["term"].endswith(" ")}
    toxic = {r["term"]: r["toxic"] for r in best}
    # A stem stands for several words: one that a single word makes up is that word.
    alone: dict[str, int] = {}
    for word, (_, n) in words.items():
        for length in STEM_LENGTHS:
            alone[word[:length]] = max(alone.get(word[:length], 0), n)
    kept: dict[str, float] = {}
    for stem in sorted(stems, key=len):
        shorter = [kept[stem[:n]] for n in STEM_LENGTHS if n < len(stem) and stem[:n] in kept]
        if toxic[stem] >= 1.5 * alone.get(stem, 0) and stems[stem] > max(shorter, default=-math.inf) + 0.5:
            kept[stem] = float(stems[stem])
    entries = [(stem, STEM, weight) for stem, weight in kept.items()]
    for word, (weight, _) in sorted(words.items()):
        if weight > max((kept[word[:n]] for n in STEM_LENGTHS if word[:n] in kept), default=-math.inf) + 0.5:
            entries.append((word, WORD, float(weight)))
    return entries


def _in_quotation(words: list[str], at: int) -> bool:
    """Whether the window around a match shows that the words are someone else's."""
    before, after = words[max(0, at - WINDOW):at + 1], words[at:at + WINDOW + 1]
    opened = any(w[0] in QUOTES for w in before)
    closed = any(w.rstrip(".,;:!?")[-1:] in QUOTES and w.rstrip(".,;:!?") for w in after)
    reported = any(w.strip(".,;:!?" + QUOTES).lower() in REPORTING for w in before[:-1] + after[1:])
    return opened and closed or reported and (opened or closed)


def text_features(text: str | None, matches: WordMatches) -> list[float]:
    words = (text or "").split()
    counts = [0] * len(STRENGTHS)
    misspelt = quoted = length = 0
    # Each run of letters is a word: a token may join several by commas, slashes or underscores.
    for at, (runs, found) in enumerate(map(matches.__getitem__, words)):
        length += runs or 1
        if not found:
            continue
        if _in_quotation(words, at):
            quoted += len(found)
            continue
        for weight, exact in found:
            if exact:
                counts[next(k for k, least in enumerate(STRENGTHS) if weight >= least)] += 1
            else:
                misspelt += 1
    rate = 100 / (length + 20)
    return [*(math.log1p(n) for n in counts), *(math.log1p(n * rate) for n in counts),
            math.log1p(misspelt), math.log1p(misspelt * rate), math.log1p(quoted), math.log1p(length) / 10]


N_FEATURES = 2 * len(STRENGTHS) + 4


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, fold: int = HELD_FOLD,
           bound: int = SAMPLE) -> tuple[list[tuple[str, str, float]], list[float]]:
    """(lexicon, coefficients), from a bounded sample of labelled documents."""
    shipped(docs.sparkSession)
    sample, weights = training_sample(docs, labels, label, folds, fold, bound, "toxicity")
    # Equal texts count once, and stay on one side of the split.
    once = sample.groupBy(F.md5("text").alias("side")).agg(F.min("text").alias("text"), F.max("label").alias("label"))
    sample = written(once, "toxicity-sample")
    first = F.conv(F.substring("side", 1, 2), 16, 10).cast("int") % 2 == 0

    def seen_through(entries: list[tuple[str, str, float]]):
        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matches = WordMatches(LexiconAutomaton(entries))
            for batch in batches:
                rows = [text_features(t, matches) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])

        return features

    seen = []
    for half, other in ((first, ~first), (~first, first)):
        through = seen_through(learned_lexicon(sample.filter(half)))
        seen += sample.filter(other).select("text", "label").mapInArrow(through, "label int, x array<double>").collect()
    entries = learned_lexicon(sample)
    x = np.array([r["x"] for r in seen]).reshape(len(seen), N_FEATURES)
    y = np.array([r["label"] for r in seen], float)
    w = np.array([weights[int(v)] for v in y])
    return entries, logistic(x, y, w / w.mean() if len(w) else w, ridge=0.5).tolist()


def scored(docs: DataFrame, model: tuple[list, list[float]], text: str = "text", score: str = "score") -> DataFrame:
    """`docs` with `score`, the chance that a whole text is toxic."""
    shipped(docs.sparkSession)
    entries, beta = model
    kept = docs.drop(score)
    schema = T.StructType([*kept.schema.fields, T.StructField(score, T.DoubleType())])

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches, coefficients = WordMatches(LexiconAutomaton(entries)), np.array(beta)
        for batch in batches:
            rows = np.array([text_features(t.as_py(), matches) for t in batch.column(text)]).reshape(batch.num_rows, N_FEATURES)
            chance = 1 / (1 + np.exp(-np.clip(rows @ coefficients[:-1] + coefficients[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance)], [*batch.schema.names, score])

    return kept.mapInArrow(chances, schema)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without those the score rejects."""
    score = fresh(docs, "score")
    return scored(docs, fitted(docs, labels), score=score).filter(F.col(score) < CUT).select(*docs.columns)


def op3_lexicon_automata(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    # Only scores leave the Python stage, not the texts again.
    marked = docs.withColumn("held_out", held_out("doc_id", FOLDS, HELD_FOLD))
    return scored(marked, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
