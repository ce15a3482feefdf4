"""A bounded, labelled sample of documents for fitting a classifier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from shelfcast.functions.tables import written
from shelfcast.llm.common import id_fold

# Hash of an id as a share of this, for samples that do not depend on the order of rows.
SHARES = 1 << 30


def held_out(doc_id: str, folds: int, fold: int):
    return F.coalesce(id_fold(F.col(doc_id), folds) == fold, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, bound: int,
                    seed: str) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, label) of about `bound` labelled documents outside the held-out fold.

    Half of the bound goes to either label, and the weights that undo this are returned. The
    sample is a share of the id's hash, so all labelled rows are equally likely. Rows without
    an id, a label of 0 or 1, or a document are left out; of labels that contradict each other
    the larger holds; of rows that repeat an id the first text by order holds. The list of ids
    is bounded, hence broadcast; texts of other rows are not moved.
    """
    usable = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id", folds, fold))
        .groupBy("doc_id").agg(F.max(label).alias("label")))
    counts = {int(k): n for k, n in usable.groupBy("label").count().collect()}
    share = {k: min(1.0, bound / 2 / n) for k, n in counts.items()}
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(SHARES)) / SHARES
    drawn = usable.filter(chance < F.when(F.col("label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    # Chance may exceed the bound by a few rows; the limit is far beyond that.
    picked = written(drawn.limit(2 * bound), "sample-ids")
    sample = (
        docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    return sample, {k: 1 / s for k, s in share.items()}


def logistic(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients of a ridge logistic regression by Newton steps; the last is the intercept.

    With one label only, the intercept alone says so.
    """
    x = np.hstack([features, np.ones((len(features), 1))])
    beta = np.zeros(x.shape[1])
    if len(x) == 0 or labels.min() == labels.max():
        beta[-1] = 0.0 if len(x) == 0 else (6.0 if labels[0] else -6.0)
        return beta
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (labels - p)) - penalty * beta
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta
