"""One model for all series: a Tweedie regression on lag features (pyspark.ml).

It stands where the original uses gradient-boosted trees with the same loss. Lag features
enter as log1p, so on the log link they act as elasticities and a recursive forecast stays
stable. Being linear on the link, its contributions are exact: weight * (value - mean).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import date

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, Window, functions as F

from shelfcast.functions.shipping import shipped
from shelfcast.functions.tables import written
from shelfcast.operators.series import LAGS

POWER = 1.2
TOLERANCE, RIDGE = 1e-3, 0.01
# Days of history a step looks back on.
LOOK_BACK = 35
LAG_FEATURES = [f"lag{k}" for k in LAGS] + [
    "rolling_mean_7", "rolling_mean_28", "rolling_std_28", "expanding_mean", "rolling_mean_28_lag7"]

# --- fixed values: feature groups shown in explanations ---------------------------------------
FEATURE_GROUPS = {
    "lag1": "Bán hôm trước", "lag2": "Bán 2–3 ngày trước", "lag3": "Bán 2–3 ngày trước",
    "lag7": "Cùng thứ tuần trước", "lag14": "Cùng thứ 2–4 tuần trước", "lag21": "Cùng thứ 2–4 tuần trước",
    "lag28": "Cùng thứ 2–4 tuần trước", "rolling_mean_7": "Xu hướng 7 ngày",
    "rolling_mean_28": "Xu hướng nền 28 ngày", "rolling_mean_28_lag7": "Xu hướng nền 28 ngày",
    "expanding_mean": "Mức bán dài hạn", "rolling_std_28": "Độ biến động 28 ngày",
    "dayofweek": "Ngày trong tuần", "day": "Ngày trong tháng", "cat_l1": "Ngành hàng",
}
LEVEL_GROUPS = ("Xu hướng nền 28 ngày", "Mức bán dài hạn", "Ngành hàng", "Độ biến động 28 ngày")


def design_names(categories: list[str]) -> list[str]:
    """Model columns: lags, weekday marks, day of month, top-category marks."""
    return (LAG_FEATURES + [f"dayofweek={d}" for d in range(1, 7)] + ["day"]
            + [f"cat_l1={c}" for c in categories[1:]])


def design(features: DataFrame, categories: list[str]) -> DataFrame:
    """Complete feature rows as model columns x0, x1, ... next to the keys."""
    columns = [F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in LAG_FEATURES]
    columns += [(F.col("dayofweek") == d).cast("double") for d in range(1, 7)]
    columns += [F.col("day") / 31.0]
    columns += [(F.col("cat_l1") == c).cast("double") for c in categories[1:]]
    return features.dropna(subset=LAG_FEATURES).select(
        "unique_id", "ds", "y", "cat_l1", *[c.alias(f"x{i}") for i, c in enumerate(columns)])


def points(rows: DataFrame, n_columns: int) -> DataFrame:
    """Design rows with their columns as one vector."""
    assembled = VectorAssembler(inputCols=[f"x{i}" for i in range(n_columns)], outputCol="x")
    return assembled.transform(rows).select("ds", "y", "x")


def fit_points(vectors: DataFrame) -> np.ndarray:
    """Intercept and weights. The fit is distributed: every iteration is one pass over the
    rows, and only the weights come back.

    The solver starts from the observed values. With many days without a sale that start is
    poor and it needs about sixteen iterations, so a smaller limit would return nonsense.
    """
    model = GeneralizedLinearRegression(
        family="tweedie", variancePower=POWER, linkPower=0.0, featuresCol="x", labelCol="y",
        maxIter=40, tol=TOLERANCE, regParam=RIDGE).fit(vectors)
    return np.concatenate([[model.intercept], model.coefficients.toArray()])


def fit(rows: DataFrame, n_columns: int) -> np.ndarray:
    vectors = points(rows, n_columns).persist()
    try:
        return fit_points(vectors)
    finally:
        vectors.unpersist()


def score(design_rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """(place, gap): how far each weight, the intercept first, is from where its fit ends.

    The gap is the slope of the penalised quasi-likelihood by that weight, over its curvature:
    the step that is left in that direction, in units of the weight. One pass over the rows.
    """
    x = [F.lit(1.0), *[F.col(f"x{i}") for i in range(len(weights) - 1)]]
    mean = F.exp(sum((F.lit(float(w)) * c for w, c in zip(weights, x)), F.lit(0.0)))
    rows = design_rows.withColumn("_mean", mean)
    pull, curve = (F.col("y") - F.col("_mean")) * F.pow("_mean", F.lit(1 - POWER)), F.pow("_mean", F.lit(2 - POWER))
    sums = rows.agg(F.sum(curve).alias("all"), *[F.sum(pull * c).alias(f"s{i}") for i, c in enumerate(x)],
                    *[F.sum(curve * c * c).alias(f"h{i}") for i, c in enumerate(x)])
    # The intercept carries no penalty. A column without a value other than 0 keeps weight 0.
    ridge = [0.0, *[RIDGE] * (len(weights) - 1)]
    gaps = [(F.col(f"s{i}") - F.lit(r * float(w)) * F.col("all")) / (F.col(f"h{i}") + F.lit(r) * F.col("all"))
            for i, (r, w) in enumerate(zip(ridge, weights))]
    return sums.select(F.posexplode(F.array(*gaps)).alias("place", "gap"))


def _recursion(weights: dict[date, np.ndarray], categories: list[str], horizon: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            past = np.array(batch["last35"].tolist(), dtype=float)
            total, count = batch["total"].to_numpy(float), batch["n"].to_numpy(float)
            beta = np.stack([weights[c] for c in batch["cutoff"]])
            marks = np.stack([(batch["cat_l1"] == c).to_numpy(float) for c in categories[1:]], axis=1) \
                if len(categories) > 1 else np.zeros((len(batch), 0))
            start = pd.to_datetime(batch["cutoff"])
            for step in range(1, horizon + 1):
                day = start + pd.Timedelta(days=step)
                lags = np.stack([past[:, -k] for k in LAGS], axis=1)
                rolled = np.stack([
                    past[:, -7:].mean(axis=1), past[:, -28:].mean(axis=1), past[:, -28:].std(axis=1, ddof=1),
                    total / count, past[:, -34:-6].mean(axis=1)], axis=1)
                weekday = np.stack([(day.dt.dayofweek == d).to_numpy(float) for d in range(1, 7)], axis=1)
                x = np.concatenate([
                    np.log1p(np.maximum(np.concatenate([lags, rolled], axis=1), 0)), weekday,
                    (day.dt.day / 31.0).to_numpy()[:, None], marks], axis=1)
                yhat = np.exp(np.clip(beta[:, 0] + (beta[:, 1:] * x).sum(axis=1), -20, 20))
                yield pd.DataFrame({
                    "unique_id": batch["unique_id"], "cutoff": batch["cutoff"], "ds": day.dt.date,
                    "model": "GlobalTweedie", "yhat": yhat, "x": list(x)})
                past = np.concatenate([past[:, 1:], yhat[:, None]], axis=1)
                total, count = total + yhat, count + 1

    return run


def top_categories(features: DataFrame) -> list[str]:
    """Names of the top-level categories, in order: a short list by nature of the tree."""
    return [r[0] for r in features.select("cat_l1").distinct().orderBy("cat_l1").collect()]


def learned_forecasts(series: DataFrame, features: DataFrame, last_days: list[date], horizon: int) -> DataFrame:
    """Fit once per cutoff on the rows up to it, then forecast step by step.

    The recursion is vectorised over all series of an Arrow batch. Days before a series began
    count as its mean, so a short series is forecast like any other. The result also carries
    `x`, the model columns of each forecast, for explanations.
    """
    categories = top_categories(features)
    rows = written(design(features, categories), "design")
    n_columns = len(design_names(categories))
    # The rows are kept in memory, or on executor disk, once; every fit is a chain of small
    # distributed jobs over those up to its cutoff, and several run side by side.
    vectors = points(rows, n_columns).persist()
    try:
        with ThreadPoolExecutor(min(6, len(last_days))) as pool:
            fitted = pool.map(lambda c: fit_points(vectors.filter(F.col("ds") <= F.lit(c))), last_days)
            weights = dict(zip(last_days, fitted))
    finally:
        vectors.unpersist()
    own = Window.partitionBy("unique_id").orderBy("ds")
    state = (
        series.select(
            "unique_id", "cat_l1", F.col("ds").alias("cutoff"),
            F.collect_list("y").over(own.rowsBetween(1 - LOOK_BACK, 0)).alias("last35"),
            F.sum("y").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
            F.count("y").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
        .filter(F.col("cutoff").isin(last_days) & (F.col("n") > 0))
        .withColumn("last35", F.concat(
            F.array_repeat(F.col("total") / F.col("n"), F.lit(LOOK_BACK) - F.size("last35")), "last35"))
    )
    shipped(series.sparkSession)
    return state.mapInPandas(
        _recursion(weights, categories, horizon),
        "unique_id string, cutoff date, ds date, model string, yhat double, x array<double>")
