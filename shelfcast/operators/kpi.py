"""Roll-ups shown in reports, computed from the analysis tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.functions.medians import banded_median, median
from shelfcast.functions.tables import written
from shelfcast.operators.marts import rows
from shelfcast.params import (
    BEFORE_HOLIDAY, CHANNEL_RETAIL, CHANNEL_WHOLESALE, QUADRANT_LOSS, Rules, WHOLE_STORE,
)


def share_of(column: str) -> Column:
    """Share of the column total. Only used on small tables (months, classes, quadrants), so
    a window over all rows sees few of them."""
    return F.try_divide(F.col(column), F.sum(column).over(Window.partitionBy()))


def channel_totals(monthly: DataFrame) -> DataFrame:
    totals = monthly.groupBy("channel").agg(
        F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"), F.sum("n_invoices").alias("n_invoices"))
    return totals.select(
        "*", share_of("n_invoices").alias("invoice_share"), share_of("revenue").alias("revenue_share"),
        F.try_divide("profit", "revenue").alias("margin"))


def monthly_by_channel(monthly: DataFrame) -> DataFrame:
    """Revenue per open day, months by sales channel; a channel without sales shows zero."""
    wide = monthly.groupBy("year_month").pivot("channel", [CHANNEL_RETAIL, CHANNEL_WHOLESALE]).agg(
        F.max("revenue_per_open_day"))
    return wide.select("year_month", *[
        F.coalesce(F.col(f"`{label}`"), F.lit(0.0)).alias(name)
        for label, name in ((CHANNEL_RETAIL, "retail"), (CHANNEL_WHOLESALE, "wholesale"))])


def heat_grid(heat: DataFrame, hours: range = range(24)) -> DataFrame:
    """Average invoices, weekdays by hours of the day; empty cells show zero."""
    wide = heat.groupBy("iso_weekday").pivot("sale_hour", list(hours)).agg(F.max("avg_invoices"))
    return wide.select("iso_weekday", *[F.coalesce(F.col(str(h)), F.lit(0.0)).alias(f"h{h}") for h in hours])


def traffic_monthly(traffic: DataFrame) -> DataFrame:
    return traffic.groupBy(F.date_format("date", "yyyy-MM").alias("year_month")).agg(
        (F.sum("n_invoices") / rows()).alias("inv_per_day"),
        F.try_divide(F.sum("revenue"), F.sum("n_invoices")).alias("basket"))


def period_shift(monthly: DataFrame, traffic_by_month: DataFrame, channels: DataFrame, late_months: int = 2,
                 skip: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the last months against the mean of all months before, per measure."""
    retail = monthly.filter(F.col("channel") == CHANNEL_RETAIL).select("year_month", "revenue_per_open_day")
    names = ["revenue_per_open_day", "inv_per_day", "basket", "retail_morning_per_day", "retail_midday_per_day",
             "retail_evening_per_day", "bulk_orders", "retail_inv_500k_plus"]
    by_month = (
        retail.join(traffic_by_month, "year_month").join(channels, "year_month")
        .filter(~F.col("year_month").isin(*skip) if skip else F.lit(True))
        .withColumn("_late", F.row_number().over(Window.orderBy(F.col("year_month").desc())) <= late_months)
    )
    long = by_month.select("_late", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        ["_late"], names, "measure", "v")
    late = F.col("_late")
    return long.groupBy("measure").agg(
        F.avg(F.when(~late, F.col("v"))).alias("early"), F.avg(F.when(late, F.col("v"))).alias("late"),
    ).withColumn("change", F.try_divide("late", "early") - 1)


def abc_summary(abc: DataFrame) -> DataFrame:
    classes = abc.groupBy("abc_class").agg(
        rows().alias("n_items"), F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"),
        median("sell_day_ratio").alias("median_sell_day_ratio"))
    return classes.select(
        "abc_class", "n_items", share_of("n_items").alias("item_share"), share_of("quantity").alias("qty_share"),
        share_of("revenue").alias("revenue_share"), "median_sell_day_ratio")


def peak_hours(heat: DataFrame) -> DataFrame:
    """Busiest hour, the two next, the quietest midday hour, and the total of each weekday."""
    by_hour = heat.groupBy(F.col("sale_hour").alias("slot")).agg(F.avg("avg_invoices").alias("value"))
    busiest = F.row_number().over(Window.orderBy(F.col("value").desc(), "slot"))
    peaks = by_hour.withColumn("_rank", busiest).filter("_rank <= 3").select(
        F.when(F.col("_rank") == 1, "peak").otherwise("second_peak").alias("kind"), "slot", "value")
    trough = by_hour.filter(F.col("slot").between(12, 15)).agg(
        F.min(F.struct("value", "slot")).alias("low")).select(F.lit("trough").alias("kind"), "low.slot", "low.value")
    weekdays = heat.groupBy(F.col("iso_weekday").alias("slot")).agg(F.sum("avg_invoices").alias("value")).select(
        F.lit("weekday").alias("kind"), "slot", "value")
    return peaks.unionByName(trough).unionByName(weekdays)


def quadrants(margin: DataFrame) -> DataFrame:
    """Per quadrant: size, revenue share, profit, and its least profitable category."""
    return margin.groupBy("quadrant").agg(
        rows().alias("n_categories"), F.sum("revenue_share").alias("revenue_share"), F.sum("profit").alias("profit"),
        F.min(F.struct("profit", "cat_l2"))["cat_l2"].alias("worst_category"))


def loss_list(margin: DataFrame, n: int | None = None) -> DataFrame:
    losses = margin.filter(F.col("quadrant") == QUADRANT_LOSS).orderBy("profit", "cat_l2")
    return losses.limit(n) if n else losses


def least_profitable(margin: DataFrame, n: int) -> DataFrame:
    lowest = margin.orderBy("profit", "cat_l2").limit(n)
    return lowest.withColumn("rank", F.row_number().over(Window.orderBy("profit", "cat_l2")))


def cost_anomalies(staged: DataFrame) -> DataFrame:
    """Per level-2 category: the fake loss its suspect costs would book, and the product that
    loses most with known cost."""
    suspects = staged.filter("is_cost_suspect").groupBy("cat_l2").agg(
        rows().alias("n_suspect"),
        F.sum(F.col("quantity") * (F.col("unit_price") - F.col("unit_cost"))).alias("suspect_loss"),
        F.sum("line_revenue").alias("suspect_revenue"))
    products = staged.filter(F.col("cost_fill_method").isNotNull()).groupBy("cat_l2", "product_name").agg(
        F.sum("line_profit").alias("profit"), F.sum("quantity").alias("qty"),
        median("unit_price").alias("price"), median("unit_cost_filled").alias("cost"))
    worst = products.groupBy("cat_l2").agg(
        F.min(F.struct(F.round("profit", 4).alias("profit"), "product_name", "qty", "price", "cost")).alias("w")).select(
        "cat_l2", F.col("w.product_name").alias("worst_product"), F.col("w.qty").alias("worst_qty"),
        F.col("w.price").alias("worst_price"), F.col("w.cost").alias("worst_cost"),
        F.col("w.profit").alias("worst_profit"))
    return worst.join(suspects, "cat_l2", "left").withColumn("n_suspect", F.coalesce("n_suspect", F.lit(0)))


def bulk_summary(bulk: DataFrame) -> DataFrame:
    # Written, since the median reads it apart from the sums.
    bulk = written(bulk.select("bulk_frequency", "n_bulk_orders", "bulk_revenue", "bulk_share_qty", "reserve_value"), "bulk_skus")
    classes = bulk.groupBy("bulk_frequency").agg(
        rows().alias("n_skus"), F.sum("n_bulk_orders").alias("n_orders"), F.sum("bulk_revenue").alias("revenue"),
        F.count_if(F.col("bulk_share_qty") > 0.5).alias("n_mostly_bulk"), F.sum("reserve_value").alias("reserve_value"))
    # A ratio of its own per article: too many values for one buffer per class.
    middle = banded_median(bulk, ["bulk_frequency"], "bulk_share_qty", "median_bulk_share")
    return classes.join(middle, "bulk_frequency", "left").withColumn("revenue_share", share_of("revenue"))


def last_28_days(traffic: DataFrame, alert_drop: float = 0.15) -> DataFrame:
    """Mean daily invoices of the last 28 days, of the 28 before, and against the whole span."""
    age = F.datediff(traffic.agg(F.max("date")).scalar(), "date")
    n = F.col("n_invoices")
    return traffic.withColumn("_age", age).agg(
        F.avg(F.when(F.col("_age") < 28, n)).alias("last_28"),
        F.avg(F.when(F.col("_age").between(28, 55), n)).alias("previous_28"),
        F.avg(n).alias("whole_span"),
    ).select(
        "*", (F.try_divide("last_28", "previous_28") - 1).alias("change"),
        (F.try_divide("last_28", "whole_span") - 1 < -alert_drop).alias("alert"))


def weekly_blocks(values: DataFrame, date_col: str, value_col: str, end: Column, future: bool = False,
                  keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum in 7-day blocks anchored on the last day of the data. Past blocks are all kept;
    future blocks only when they have seven rows."""
    offset = F.datediff(date_col, end)
    block = F.floor((offset - 1) / 7) if future else F.floor(-offset / 7)
    sums = values.groupBy(*keys, block.alias("block")).agg(F.sum(value_col).alias("value"), rows().alias("n_days"))
    start = F.date_add(end, (F.col("block") * 7 + 1).cast("int")) if future else F.date_sub(
        end, (F.col("block") * 7 + 6).cast("int"))
    blocks = sums.withColumn("block_start", start)
    return blocks.filter("n_days = 7") if future else blocks


def holiday_top(effect: DataFrame, min_revenue_per_day: float = 50_000) -> DataFrame:
    return effect.filter(
        (F.col("holiday_window") == BEFORE_HOLIDAY) & (F.col("cat_l1") != WHOLE_STORE)
        & (F.col("rev_per_day") > min_revenue_per_day))


def days_around(traffic: DataFrame, holidays: tuple[date, ...], before: int, after: int) -> DataFrame:
    """Every day around each holiday; days without a sale keep null figures."""
    spark = traffic.sparkSession
    days = (
        spark.createDataFrame([(h,) for h in holidays], "holiday date")
        .withColumn("date", F.explode(F.sequence(F.date_sub("holiday", before), F.date_add("holiday", after))))
    )
    return days.join(traffic, "date", "left").select("holiday", "date", "n_invoices", "revenue", "quantity")
