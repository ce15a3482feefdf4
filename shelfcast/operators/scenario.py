"""What-if questions on top of the order plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfcast.params import BEFORE_HOLIDAY, WHOLE_STORE


def discount(plan: DataFrame, response: DataFrame, discount_pct: float, cannibal_pct: float) -> DataFrame:
    """Weekly demand per top category after a discount. Part of the gain is taken from other
    articles of the category; unreliable slopes fall back to the store's."""
    base = plan.groupBy("cat_l1").agg(
        F.sum("forecast_week").alias("base_week"), F.sum("order_qty").alias("base_order"))
    slope = F.when(F.col("reliable"), F.col("uplift_per_pct")).otherwise(F.col("store_uplift_per_pct"))
    return (
        base.join(response, "cat_l1").withColumn("slope", slope)
        .withColumn("net_factor", 1 + F.col("slope") * discount_pct * (1 - cannibal_pct / 100))
        .withColumn("scenario_week", F.col("base_week") * F.col("net_factor"))
        .withColumn("extra_order", F.greatest(F.col("base_order") * (F.col("net_factor") - 1), F.lit(0.0)))
        .select("cat_l1", "slope", "net_factor", "base_week", "scenario_week", "extra_order")
    )


def holiday(plan: DataFrame, effect: DataFrame, closed_days: int, stock_up_pct: float) -> DataFrame:
    """Need of the 14 days before a holiday, and stocking up for closed days beyond seven."""
    before = effect.filter((F.col("holiday_window") == BEFORE_HOLIDAY) & (F.col("cat_l1") != WHOLE_STORE))
    day = F.col("forecast_week") / 7
    return (
        plan.groupBy("cat_l1").agg(F.sum("forecast_week").alias("forecast_week"))
        .join(before.select("cat_l1", "qty_factor"), "cat_l1", "left")
        .withColumn("qty_factor", F.coalesce("qty_factor", F.lit(1.0)))
        .withColumn("normal_two_weeks", day * 14)
        .withColumn("before_holiday", day * 14 * F.col("qty_factor"))
        .withColumn("stock_up", day * max(closed_days - 7, 0) * stock_up_pct / 100)
        .withColumn("total", F.col("before_holiday") + F.col("stock_up"))
        .drop("forecast_week")
    )
