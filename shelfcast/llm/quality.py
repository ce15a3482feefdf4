"""Quality by naive Bayes support vectors.

A text's features are the n-grams of its bytes that occur in it (1 to 4 bytes, hashed), and how
often a word bigram repeats its word; each is an indicator. An n-gram is scaled by the log ratio of its shares in good and bad texts; on the
scaled indicators a linear hinge-loss model is fitted by dual coordinate descent and drawn
towards the ratios alone. A logistic curve, fitted on texts the model has not seen, turns the
margin into a score.

Ratios and model come from a bounded sample of labelled rows (`SAMPLE`). A text has at most
`DIMENSIONS` features, whatever its length, and travels as a list of them or a bit each, whichever
is shorter: 16 KB at most, so the driver holds 200 MB at most. Every whole text is scored. Labels, language,
source and id are never inputs of a score.

Nulls and edge cases: a null text is an empty one, whose score is that of no n-grams; a null id
is not held out; rows may repeat; without labelled rows of both kinds the score says what kind
there was, or 0.5; no rows give no rows. All columns pass through, and `score` is added
(replaced if there).
"""

from __future__ import annotations

import operator
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shelfcast.functions.shipping import shipped
from shelfcast.functions.tables import written
from shelfcast.llm.common import table
from shelfcast.llm.labels import held_out, logistic, training_sample

FOLDS, HELD_FOLD, CUT = 5, 0, 0.3
# Documents the model is fitted on, at most.
SAMPLE = 6000
DIMENSIONS = 1 << 17
ORDERS = (1, 2, 3, 4)
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
# Share of the fitted model against the plain ratios.
BLEND = 0.75
MIX = np.uint32(2654435761)
REPEATS = (1, 2, 4, 8, 16, 32, 64)


def ngrams(text: str | None) -> np.ndarray:
    """Sorted distinct hashed n-grams of a text's bytes."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    parts = []
    for order in ORDERS:
        count = len(data) - order + 1
        if count <= 0:
            break
        code = np.full(count, order, np.uint32)
        for place in range(order):
            code = (code * np.uint32(0x01000193)) ^ data[place:place + count]
        parts.append((code * MIX) >> np.uint32(32 - DIMENSIONS.bit_length() + 1))
    if not parts:
        return np.zeros(0, np.int64)
    # Bigrams of a word and itself, or the word before the last one: at least so many, in all and of 16.
    words = text.split()
    for gap in (1, 2):
        same = sum(map(operator.eq, words, words[gap:]))
        marks = [gap * 64 + k for k, least in enumerate(REPEATS) if same >= least]
        marks += [gap * 64 + 32 + k for k in range(1, 9) if 16 * same >= k * len(words)]
        parts.append((np.array(marks, np.uint32) * MIX) >> np.uint32(32 - DIMENSIONS.bit_length() + 1))
    present = np.zeros(DIMENSIONS, bool)
    for part in parts:
        present[part] = True
    return np.flatnonzero(present)


def packed(row: np.ndarray) -> bytes:
    """Features of a text in `DIMENSIONS` bits at most."""
    if 32 * len(row) < DIMENSIONS:
        return row.astype(np.uint32).tobytes()
    bits = np.zeros(DIMENSIONS, bool)
    bits[row] = True
    return np.packbits(bits).tobytes()


class PackedRows(Sequence):
    """Features of texts, unpacked one text at a time."""

    def __init__(self, rows: list[bytes]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        row = self.rows[i]
        if 8 * len(row) < DIMENSIONS:
            return np.frombuffer(row, np.uint32).astype(np.int64)
        return np.flatnonzero(np.unpackbits(np.frombuffer(row, np.uint8)))

    def taken(self, places: np.ndarray) -> PackedRows:
        return PackedRows([self.rows[i] for i in places])


def log_ratios(rows: Sequence[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log of each n-gram's share among good texts over that among bad ones."""
    seen = np.full((2, DIMENSIONS), SMOOTHING)
    for row, label in zip(rows, labels):
        seen[int(label), row] += 1
    bad, good = (np.log(seen[k] / (np.count_nonzero(labels == k) + 2 * SMOOTHING)) for k in (0, 1))
    return good - bad


def hinge_fit(rows: Sequence[np.ndarray], signs: np.ndarray, ratios: np.ndarray, costs: np.ndarray, seed: int = 8) -> np.ndarray:
    """Weights of n-grams by dual coordinate descent on the hinge loss, ratios included.

    One dual variable per text between 0 and its cost; each step solves its own exactly and moves
    the weights. Scaled rows have length one at most, so that long texts weigh as short ones.
    """
    rng = np.random.default_rng(seed)
    scales = np.array([1 / max(np.sqrt((ratios[r] ** 2).sum()), 1e-9) for r in rows])
    weights, bias, dual = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            row = rows[i]
            x = ratios[row] * scales[i]
            slope = signs[i] * (weights[row] @ x + bias) - 1
            moved = min(max(dual[i] - slope / (x @ x + 1), 0.0), costs[i])
            if moved != dual[i]:
                weights[row] += (moved - dual[i]) * signs[i] * x
                bias += (moved - dual[i]) * signs[i]
                dual[i] = moved
    # The bias is one more feature; it goes with the curve, which has its own intercept.
    return weights * ratios


def margin(row: np.ndarray, weights: np.ndarray, ratios: np.ndarray) -> float:
    length = np.sqrt((ratios[row] ** 2).sum())
    return float(weights[row].sum() / length) if length else 0.0


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, fold: int = HELD_FOLD,
           bound: int = SAMPLE) -> dict:
    """The model: weights, ratios, and the two numbers of the curve."""
    shipped(docs.sparkSession)
    sample, weights = training_sample(docs, labels, label, folds, fold, bound, "quality")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [packed(ngrams(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("side"), batch.column("label").cast(pa.int32()), pa.array(rows, pa.binary())], ["side", "label", "x"])

    once = sample.groupBy(F.md5("text").alias("side")).agg(F.min("text").alias("text"), F.max("label").alias("label"))
    seen = written(once.mapInArrow(features, "side string, label int, x binary"), "quality-sample").orderBy("side").collect()
    rows = PackedRows([bytes(r["x"]) for r in seen])
    y = np.array([r["label"] for r in seen], float)
    each = np.array([weights[int(v)] for v in y])
    if len(set(y.tolist())) < 2:
        return {"weights": np.zeros(DIMENSIONS, np.float32), "ratios": np.ones(DIMENSIONS, np.float32),
                "curve": logistic(np.zeros((len(y), 1)), y, each).tolist()}
    each /= each.mean()

    def learn(take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chosen = rows.taken(take)
        ratios = log_ratios(chosen, y[take])
        fit = hinge_fit(chosen, 2 * y[take] - 1, ratios, COST * each[take])
        plain = np.abs(fit).sum() / max(np.abs(ratios).sum(), 1e-12) * ratios
        return BLEND * fit + (1 - BLEND) * plain, ratios

    # The curve sees margins of texts outside the half that gave them.
    halves = [np.arange(0, len(rows), 2), np.arange(1, len(rows), 2)]
    margins = np.zeros(len(rows))
    for fit_on, tell in (halves, halves[::-1]):
        if len(set(y[fit_on].tolist())) < 2:
            continue
        weights_, ratios_ = learn(fit_on)
        margins[tell] = [margin(rows[i], weights_, ratios_) for i in tell]
    weights_, ratios_ = learn(np.arange(len(rows)))
    return {"weights": weights_.astype(np.float32), "ratios": ratios_.astype(np.float32),
            "curve": logistic(margins[:, None], y, each, ridge=1e-3).tolist()}


def scored(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """`docs` with `score`, the chance that a whole text is of quality."""
    shipped(docs.sparkSession)
    kept = docs.drop("score")
    # A fixed number of weights, sent once to each executor.
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, ratios = sent.value["weights"].astype(float), sent.value["ratios"].astype(float)
        slope, intercept = sent.value["curve"]
        for batch in batches:
            margins = np.array([margin(ngrams(t.as_py()), weights, ratios) for t in batch.column(text)])
            chance = 1 / (1 + np.exp(-np.clip(margins * slope + intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance, pa.float64())], [*batch.schema.names, "score"])

    return kept.mapInArrow(score, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))


def op8_bayes_support_vectors(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    marked = docs.withColumn("held_out", held_out("doc_id", FOLDS, HELD_FOLD))
    return scored(marked, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
