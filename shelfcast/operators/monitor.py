"""Saved forecasts against what was sold, drift, and the decision to retrain."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.operators.marts import rows
from shelfcast.params import Rules, SNAPSHOT_REPLAY

SNAPSHOT_COLUMNS = {
    "run_id": "string", "kind": "string", "created_at": "timestamp", "data_until": "timestamp",
    "week_start": "timestamp", "model": "string", "unique_id": "string", "forecast_week": "double",
    "order_qty": "double",
}


def as_snapshots(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in SNAPSHOT_COLUMNS.items()])


def plan_snapshot(plan: DataFrame, run_id: str, kind: str, model: str, data_until: date, created_at: Column) -> DataFrame:
    return as_snapshots(
        plan.withColumn("run_id", F.lit(run_id)).withColumn("kind", F.lit(kind)).withColumn("model", F.lit(model))
        .withColumn("created_at", created_at).withColumn("data_until", F.lit(data_until))
        .withColumn("week_start", F.date_add("data_until", 1)))


def upsert(snapshots: DataFrame, new: DataFrame) -> DataFrame:
    """Keep one run per (kind, data_until): the new one replaces an older one."""
    replaced = new.select("kind", "data_until").distinct()
    return snapshots.join(replaced, ["kind", "data_until"], "left_anti").select(*SNAPSHOT_COLUMNS).unionByName(new)


def backfill(weeks: DataFrame, chosen: str) -> DataFrame:
    """Hold-out forecasts as if each week's run had been saved at the time."""
    held = weeks.filter((F.col("phase") == "holdout") & (F.col("model") == chosen))
    return as_snapshots(held.select(
        F.concat(F.lit("backtest-"), F.date_format("cutoff", "yyyyMMdd")).alias("run_id"),
        F.lit(SNAPSHOT_REPLAY).alias("kind"), F.col("cutoff").alias("created_at"), F.col("cutoff").alias("data_until"),
        F.date_add("cutoff", 1).alias("week_start"), "model", "unique_id", F.col("yhat").alias("forecast_week"),
        F.lit(None).alias("order_qty")))


def sold_in_weeks(snapshots: DataFrame, series: DataFrame) -> DataFrame:
    """What was sold on the open days of each saved week that `series` knows.

    Each saved week becomes its seven days, so the join with daily sales is an equi-join.
    """
    start = F.to_date("week_start")
    days = snapshots.select("run_id", "unique_id", F.explode(F.sequence(start, F.date_add(start, 6))).alias("ds"))
    sold = series.filter(~F.col("is_closed")).select("unique_id", "ds", "y_raw")
    return days.join(sold, ["unique_id", "ds"]).groupBy("run_id", "unique_id").agg(F.sum("y_raw").alias("actual"))


def score_runs(snapshots: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per run: its forecasts against (run_id, unique_id, actual)."""
    error = F.col("forecast_week") - F.col("actual")
    return snapshots.join(actual, ["run_id", "unique_id"]).groupBy("run_id").agg(
        F.max("kind").alias("kind"), F.max("week_start").alias("week_start"), F.max("model").alias("model"),
        F.try_divide(F.sum(F.abs(error)), F.sum("actual")).alias("wmape"),
        F.try_divide(F.sum(error), F.sum("actual")).alias("bias"),
        F.sum("actual").alias("actual_total"), F.sum("forecast_week").alias("forecast_total"),
        rows().alias("n_series"))


def passed_weeks(snapshots: DataFrame, last_day: Column) -> DataFrame:
    return snapshots.filter(F.date_add(F.to_date("week_start"), 6) <= last_day)


def evaluate_snapshots(snapshots: DataFrame, series: DataFrame, last_day: Column) -> DataFrame:
    """Runs whose week has passed, scored on the days sold."""
    passed = passed_weeks(snapshots, last_day)
    return score_runs(passed, sold_in_weeks(passed, series))


def drift(runs: DataFrame, reference_wmape: Column, rules: Rules) -> DataFrame:
    """Every scored week with its running tracking signal and whether it raised an alarm.

    One row per weekly run: windows per kind stay small.
    """
    so_far = Window.partitionBy("kind").orderBy("week_start").rowsBetween(Window.unboundedPreceding, 0)
    error = F.col("forecast_total") - F.col("actual_total")
    signal = F.try_divide(F.sum(error).over(so_far), F.avg(F.abs(error)).over(so_far))
    latest = Window.partitionBy("kind").orderBy(F.col("week_start").desc())
    return (
        runs.withColumn("tracking_signal", F.coalesce(signal, F.lit(0.0)))
        .withColumn("over_limit", F.coalesce(F.col("wmape") > reference_wmape * rules.drift_factor, F.lit(False)))
        .withColumn("biased", F.abs("tracking_signal") > rules.ts_limit)
        .withColumn("flagged", F.col("over_limit") | F.col("biased"))
        .withColumn("is_latest", F.row_number().over(latest) == 1)
    )


def drift_status(flags: DataFrame) -> DataFrame:
    """Per kind: state of the latest week, whether to retrain, and all weeks that alarmed."""
    latest = F.col("is_latest")
    state = F.when(F.col("over_limit"), "error").when(F.col("biased"), "bias").otherwise("ok")
    week = F.date_format("week_start", "yyyy-MM-dd")
    return flags.groupBy("kind").agg(
        rows().alias("n_weeks"), F.max(F.when(latest, state)).alias("state"),
        F.max(F.when(latest, F.col("flagged"))).alias("retrain"),
        F.max(F.when(latest, F.col("tracking_signal"))).alias("tracking_signal"),
        F.count_if("flagged").alias("n_flagged"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("flagged"), week)))).alias("flagged_weeks"))


def retrain_decision(calendar: DataFrame, trained_until: date | None, status: DataFrame, kind: str) -> DataFrame:
    """Retrain without an earlier run, after seven new days, or when the latest week drifted."""
    newest = calendar.agg(F.max("date").alias("data_until"))
    drifted = F.coalesce(status.filter(F.col("kind") == kind).agg(F.max("retrain")).scalar(), F.lit(False))
    days = F.datediff("data_until", F.lit(trained_until)) if trained_until else F.lit(None).cast("int")
    return newest.withColumn("new_days", days).withColumn("drifted", drifted).withColumn(
        "retrain", F.col("new_days").isNull() | (F.col("new_days") >= 7) | F.col("drifted"))


def total_accuracy(runs: DataFrame) -> DataFrame:
    gap = F.abs(F.col("forecast_total") - F.col("actual_total"))
    return runs.groupBy("kind").agg(
        rows().alias("n_weeks"), (1 - F.try_divide(F.sum(gap), F.sum("actual_total"))).alias("accuracy"))


def snapshot_list(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("run_id").agg(
        F.max("kind").alias("kind"), F.max("week_start").alias("week_start"), F.max("created_at").alias("created_at"),
        F.sum("forecast_week").alias("forecast_total"))
