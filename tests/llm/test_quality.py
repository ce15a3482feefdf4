"""Quality: features, the dual solution, held-out accuracy, awkward rows."""

import numpy as np
import pandas as pd

from shelfcast.llm import quality
from shelfcast.llm.quality import (
    DIMENSIONS, PackedRows, fitted, hinge_fit, log_ratios, ngrams, op8_bayes_support_vectors, packed, scored)

SF = "/root/testdata/sf0.01"


def test_ngrams_are_indicators_of_the_whole_text():
    assert len(ngrams("")) == len(ngrams(None)) == 0
    assert ngrams("ab").tolist() == ngrams("ab").tolist() != ngrams("ba").tolist()
    far = "x" * 100000
    assert len(np.setdiff1d(ngrams(far + "!?"), ngrams(far))) > 0


def test_rows_of_any_size_pack_into_a_bit_a_feature():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(DIMENSIONS, n, replace=False)) for n in (0, 1, 4095, 4096, 4097, 90000, DIMENSIONS)]
    sent = [packed(r) for r in rows]
    assert max(map(len, sent)) == DIMENSIONS // 8
    assert all((a == b).all() for a, b in zip(rows, PackedRows(sent)))


def test_dual_descent_reaches_the_primal_optimum(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 400)
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(12, 5, replace=False)) for _ in range(60)]
    y = np.array([1.0 if 3 in r or 4 in r else -1.0 for r in rows])
    y[:4] *= -1
    ratios, costs = log_ratios(rows, (y + 1) / 2), np.full(60, 0.7)
    weights = np.divide(hinge_fit(rows, y, ratios, costs), ratios, out=np.zeros(DIMENSIONS), where=np.abs(ratios) > 1e-12)[:12]
    x = np.zeros((60, 12))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / np.sqrt((ratios[r] ** 2).sum())
    x = np.hstack([x, np.ones((60, 1))])
    value = lambda w: w @ w / 2 + (costs * np.maximum(0, 1 - y * (x @ w))).sum()
    best = min(value(np.append(weights, b)) for b in np.linspace(-3, 3, 1201))
    for _ in range(300):
        trial = np.append(weights, 0) + rng.normal(0, 0.05, 13)
        assert min(value(np.append(trial[:12], b)) for b in np.linspace(-3, 3, 61)) >= best - 1e-3


def test_held_out_accuracy(spark):
    got = op8_bayes_support_vectors(spark, SF).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    told = got.merge(pd.read_parquet(SF + "/labels.parquet"), on="doc_id")
    held = told[told.held_out]
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.9


def test_awkward_rows_keep_their_columns(spark, awkward, empty):
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(60)] + [(None, 1), (0, 1), (1, None), (999, 1)], "doc_id long, quality int")
    model = fitted(awkward, labels)
    rows = scored(awkward, model)
    assert sorted(rows.columns) == sorted(awkward.columns)
    assert rows.filter("score between 0 and 1").count() == awkward.count()
    assert scored(empty, model).count() == 0
    assert scored(awkward, fitted(awkward, labels.limit(0))).filter("score = 0.5").count() == awkward.count()
