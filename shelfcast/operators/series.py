"""Daily demand series per category: dense, imputed, classified, with features.

All windows here run within one series, whose length is bounded by the calendar.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.functions.holidays import holiday_offset, near_holiday
from shelfcast.functions.medians import median
from shelfcast.operators.marts import rows
from shelfcast.params import Rules

LAGS = (1, 2, 3, 7, 14, 21, 28)


def dense_series(daily: DataFrame, calendar: DataFrame, rules: Rules) -> DataFrame:
    """Every category on every calendar day; y_raw is null on closed days, not zero."""
    level = rules.series_level
    # At level 3 a name under two parents repeats the same figure; above it figures add up.
    combine = F.max if level == "cat_l3" else F.sum
    sold = daily.groupBy(F.col(level).alias("unique_id"), F.col("date").alias("ds")).agg(
        combine("quantity").alias("y_raw"))
    days = calendar.select(F.col("date").alias("ds"), (~F.col("is_open")).alias("is_closed"))
    span = days.agg(F.struct(F.min("ds").alias("first"), F.max("ds").alias("last"))).scalar()
    categories = daily.groupBy(F.col(level).alias("unique_id")).agg(
        F.min("cat_l1").alias("cat_l1"), F.min("cat_l2").alias("cat_l2"))
    grid = categories.withColumn("_span", span).withColumn(
        "ds", F.explode(F.sequence("_span.first", "_span.last"))).drop("_span")
    return (
        grid.join(days, "ds").join(sold, ["unique_id", "ds"], "left")
        .withColumn("in_holiday_window", near_holiday(holiday_offset("ds", rules), rules))
        .select("unique_id", "ds", "y_raw", "is_closed", "in_holiday_window", "cat_l1", "cat_l2")
    )


def imputed(series: DataFrame, rules: Rules) -> DataFrame:
    """Add `y`: closed and holiday days take the median of the same weekday in the last
    weeks. Later weeks serve only where there is no earlier clean one, at the very start,
    so values inside any backtest never depend on the future.
    """
    abnormal = F.col("is_closed") | F.col("in_holiday_window")
    same_weekday = Window.partitionBy("unique_id", F.weekday("ds")).orderBy("ds")
    weeks = rules.impute_weeks
    past = median("_clean").over(same_weekday.rowsBetween(-weeks, -1))
    following = median("_clean").over(same_weekday.rowsBetween(1, weeks))
    return (
        series.withColumn("is_imputed", abnormal)
        .withColumn("_clean", F.when(~abnormal, F.col("y_raw")))
        .withColumn("y", F.when(abnormal, F.coalesce(past, following, F.lit(0.0))).otherwise(F.col("y_raw")))
        .drop("_clean")
    )


def demand_classes(series: DataFrame, rules: Rules, until: date | None = None) -> DataFrame:
    """Interval between selling days and variability of their size decide the class."""
    known = series.filter(~F.col("is_closed"))
    if until is not None:
        known = known.filter(F.col("ds") <= F.lit(until))
    selling = F.when(F.col("y_raw") > 0, F.col("y_raw"))
    profile = known.groupBy("unique_id").agg(
        F.min("cat_l1").alias("cat_l1"), F.min("cat_l2").alias("cat_l2"),
        F.count(selling).alias("sale_days"), rows().alias("open_days"),
        F.try_divide(rows(), F.count(selling)).alias("adi"),
        F.pow(F.try_divide(F.stddev_samp(selling), F.avg(selling)), 2).alias("cv2"),
        F.sum("y_raw").alias("total_qty"), F.avg("y_raw").alias("mean_daily_qty"))
    frequent = F.coalesce(F.col("adi") < rules.adi_cut, F.lit(False))
    steady = F.coalesce(F.col("cv2") < rules.cv2_cut, F.lit(False))
    return profile.withColumn(
        "demand_class",
        F.when(F.col("sale_days") < rules.min_sale_days, "insufficient")
        .when(frequent & steady, "smooth").when(frequent, "erratic").when(steady, "intermittent")
        .otherwise("lumpy"))


def features(series: DataFrame) -> DataFrame:
    """Lags, rolling and expanding statistics of earlier days, and date parts. A rolling
    value is null until its window is full."""
    own = Window.partitionBy("unique_id").orderBy("ds")

    def rolling(agg, first: int, last: int) -> Column:
        frame = own.rowsBetween(first, last)
        return F.when(F.count("y").over(frame) == last - first + 1, agg("y").over(frame))

    return series.select(
        "unique_id", "ds", "y", "cat_l1",
        *[F.lag("y", k).over(own).alias(f"lag{k}") for k in LAGS],
        rolling(F.avg, -7, -1).alias("rolling_mean_7"),
        rolling(F.avg, -28, -1).alias("rolling_mean_28"),
        rolling(F.stddev_samp, -28, -1).alias("rolling_std_28"),
        F.avg("y").over(own.rowsBetween(Window.unboundedPreceding, -1)).alias("expanding_mean"),
        rolling(F.avg, -34, -7).alias("rolling_mean_28_lag7"),
        F.weekday("ds").alias("dayofweek"), F.dayofmonth("ds").alias("day"))


def cutoffs(last_day: date, horizon: int, n_windows: int, step: int) -> list[date]:
    """Last known days of the backtest windows, oldest first; the newest window ends on the
    last day of the data."""
    newest = last_day - timedelta(days=horizon)
    return [newest - timedelta(days=step * k) for k in reversed(range(n_windows))]


def walk_forward(series: DataFrame, last_days: list[date], horizon: int, n_selection: int) -> DataFrame:
    """The days each backtest window has to forecast, with its number and phase."""
    windows = F.array(*[
        F.struct(F.lit(c).alias("cutoff"), F.lit(i).alias("window"),
                 F.lit("selection" if i <= n_selection else "holdout").alias("phase"))
        for i, c in enumerate(last_days, start=1)])
    ahead = F.datediff("ds", "cutoff")
    return (
        series.filter(F.col("ds") > F.lit(last_days[0])).select("*", F.inline(windows))
        .filter(ahead.between(1, horizon))
    )
