"""Why the global model forecasts what it does. On its log link the model is linear, so the
contribution of a column is exactly weight * (value - mean value)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.operators.learner import FEATURE_GROUPS, LEVEL_GROUPS, design_names


def group_of(column: str) -> str:
    name = column.split("=")[0]
    return FEATURE_GROUPS.get(name, name)


def _contributions(x: Column, weights: np.ndarray, means: Column, names: list[str]) -> Column:
    return F.array(*[
        F.struct(F.lit(group_of(name)).alias("group"),
                 (F.lit(float(weights[i + 1])) * (x[i] - means[i])).alias("c"))
        for i, name in enumerate(names)])


def column_means(design_rows: DataFrame, n: int) -> Column:
    return design_rows.agg(F.array(*[F.avg(f"x{i}") for i in range(n)])).scalar()


def global_importance(design_rows: DataFrame, weights: np.ndarray, categories: list[str]) -> DataFrame:
    """Mean absolute contribution per feature group, over all training rows."""
    names = design_names(categories)
    x = F.array(*[F.col(f"x{i}") for i in range(len(names))])
    means = F.array(*[F.col("_m")[i] for i in range(len(names))])
    one_pass = design_rows.withColumn("_m", column_means(design_rows, len(names))).agg(*[
        F.avg(F.abs(F.lit(float(weights[i + 1])) * (x[i] - means[i]))).alias(f"c{i}") for i in range(len(names))])
    long = F.array(*[F.struct(F.lit(group_of(n)).alias("group"), F.col(f"c{i}").alias("c")) for i, n in enumerate(names)])
    return one_pass.select(F.inline(long)).groupBy("group").agg(F.sum("c").alias("mean_abs_contribution"))


def local_contributions(forecasts: DataFrame, design_rows: DataFrame, weights: np.ndarray,
                        categories: list[str], days: int = 7) -> DataFrame:
    """Contribution and percent effect of each feature group, per series and forecast day."""
    names = design_names(categories)
    base = F.lit(float(weights[0])) + sum(
        (F.lit(float(weights[i + 1])) * F.col("_m")[i] for i in range(len(names))), F.lit(0.0))
    return (
        forecasts.filter(F.datediff("ds", "cutoff") <= days)
        .withColumn("_m", column_means(design_rows, len(names))).withColumn("base_value", base)
        .select("unique_id", "ds", "base_value", F.inline(_contributions(F.col("x"), weights, F.col("_m"), names)))
        .groupBy("unique_id", "ds", "base_value", "group").agg(F.sum("c").alias("contribution"))
        .withColumn("effect_pct", F.exp("contribution") - 1)
    )


def waterfall(local: DataFrame) -> DataFrame:
    """From the usual level to the forecast: level groups form the start, then the other
    groups multiply it one by one, the strongest first. A dozen groups per series and day."""
    is_level = F.col("group").isin(*LEVEL_GROUPS)
    steps = local.groupBy("unique_id", "ds").agg(
        (F.max("base_value") + F.sum(F.when(is_level, F.col("contribution")).otherwise(0.0))).alias("start"))
    strongest = Window.partitionBy("unique_id", "ds").orderBy(F.abs("contribution").desc(), "group")
    return (
        local.filter(~is_level).join(steps, ["unique_id", "ds"])
        .withColumn("step", F.row_number().over(strongest))
        .withColumn("_to", F.exp(F.col("start") + F.sum("contribution").over(
            strongest.rowsBetween(Window.unboundedPreceding, 0))))
        .select("unique_id", "ds", "step", "group", F.exp("start").alias("start"),
                (F.col("_to") / F.exp("contribution")).alias("from_level"), F.col("_to").alias("to_level"), "effect_pct")
    )
