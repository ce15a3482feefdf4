"""Data-quality checks on raw lines, staged lines and the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.functions.holidays import holiday_offset
from shelfcast.operators.marts import open_day_count, rows
from shelfcast.operators.staging import retail_sale, standard_retail
from shelfcast.params import COST_UNFILLED, Rules, UNKNOWN_BRAND


def overview(raw: DataFrame, staged: DataFrame) -> DataFrame:
    return (
        staged.agg(
            rows().alias("staged_lines"), F.min("sale_date").alias("first_day"), F.max("sale_date").alias("last_day"),
            F.sum("line_revenue").alias("revenue"))
        .withColumn("raw_lines", raw.agg(rows()).scalar())
        .withColumn("duplicates", F.col("raw_lines") - F.col("staged_lines"))
        .withColumn("n_invoices", staged.agg(F.count_distinct("invoice_id")).scalar())
        .withColumn("n_skus", staged.agg(F.count_distinct("sku")).scalar())
    )


def has_totals(raw: DataFrame) -> DataFrame:
    """Whether the file carries the month and invoice totals the reconciliation needs."""
    return raw.agg(((F.count("month_revenue") > 0) & (F.count("invoice_revenue") > 0)).alias("has_totals"))


def reconcile_months(raw: DataFrame, staged: DataFrame) -> DataFrame:
    """Recomputed revenue against the month total repeated on every raw line."""
    told = raw.groupBy("period_month").agg(F.max("month_revenue").alias("file_revenue"))
    ours = staged.groupBy(F.date_format("sale_date", "MM-yyyy").alias("period_month")).agg(
        F.sum("line_revenue").alias("our_revenue"))
    return told.join(ours, "period_month").withColumn("diff", F.col("our_revenue") - F.col("file_revenue"))


def reconcile_invoices(raw: DataFrame) -> DataFrame:
    """Share of invoices whose lines add up to the invoice total, within 1 and within 100."""
    gaps = raw.groupBy("invoice_id").agg(
        F.abs(F.sum(F.col("quantity") * F.col("unit_price")) - F.max("invoice_revenue")).alias("gap"))
    within = lambda limit: F.avg(F.when(F.col("gap") <= limit, 1.0).otherwise(0.0))
    return gaps.agg(within(1).alias("within_1"), within(100).alias("within_100"), rows().alias("n_invoices"))


ISSUES: dict[str, str] = {
    "return": "is_return",
    "edited_invoice": "is_edited_invoice",
    "cost_missing": "cost_missing",
    "zero_price": "is_zero_price",
    "opening_promo": "is_opening_promo",
    "fractional_quantity": "is_fractional_qty",
    "unknown_brand": f"brand = '{UNKNOWN_BRAND}'",
    "deleted_sku": "sku_deleted",
    "cost_suspect": "is_cost_suspect",
    "credit_sale": "is_credit_sale",
}


def issue_counts(staged: DataFrame) -> DataFrame:
    """Lines and revenue of each issue, all counted in one pass."""
    sums: list[Column] = [F.sum("line_revenue").alias("_total")]
    for name, condition in ISSUES.items():
        sums += [F.count_if(F.expr(condition)).alias(f"n_{name}"),
                 F.sum(F.when(F.expr(condition), F.col("line_revenue"))).alias(f"r_{name}")]
    long = F.array(*[
        F.struct(F.lit(name).alias("issue"), F.col(f"n_{name}").alias("n_lines"),
                 F.coalesce(f"r_{name}", F.lit(0.0)).alias("revenue"),
                 F.try_divide(F.abs(F.col(f"r_{name}")), F.col("_total")).alias("revenue_share"))
        for name in ISSUES])
    return staged.agg(*sums).select(F.inline(long))


def cost_fill_counts(staged: DataFrame) -> DataFrame:
    return staged.filter("cost_missing").groupBy(
        F.coalesce("cost_fill_method", F.lit(COST_UNFILLED)).alias("method")).agg(rows().alias("n_lines"))


def category_tree(raw: DataFrame, staged: DataFrame, rules: Rules) -> DataFrame:
    """Size of the category tree, lines with a repaired path, lines that lack a level.

    The staged lines shrink to their distinct paths before the three distinct counts.
    """
    paths = staged.groupBy("cat_l1", "cat_l2", "cat_l3", "category_path").agg(rows().alias("n"))
    repaired = raw.filter(F.trim("category_path").isin(*rules.category_fixes)).agg(rows()).scalar()
    return paths.agg(
        F.count_distinct("cat_l1").alias("n_l1"), F.count_distinct("cat_l2").alias("n_l2"),
        F.count_distinct("cat_l3").alias("n_l3"),
        F.sum(F.when(~F.col("category_path").like("%>>%>>%"), F.col("n")).otherwise(0)).alias("short_path_lines"),
    ).withColumn("repaired_lines", repaired)


def channel_mix(staged: DataFrame) -> DataFrame:
    mix = staged.groupBy("txn_channel").agg(
        rows().alias("n_lines"), F.count_distinct("invoice_id").alias("n_invoices"),
        F.sum("quantity").alias("quantity"), F.sum("line_revenue").alias("revenue"))
    # Four channels at most: the unpartitioned window sees four rows.
    whole = Window.partitionBy()
    return mix.select(
        "txn_channel", "n_lines", "n_invoices",
        (F.col("quantity") / F.sum("quantity").over(whole)).alias("qty_share"),
        (F.col("revenue") / F.sum("revenue").over(whole)).alias("revenue_share"))


def closed_runs(calendar: DataFrame, rules: Rules, min_days: int = 3) -> DataFrame:
    """Runs of closed days, flagged when they start near a holiday. Calendar rows only."""
    place = F.row_number().over(Window.orderBy("date"))
    among_closed = F.row_number().over(Window.partitionBy("is_open").orderBy("date"))
    runs = (
        calendar.withColumn("_run", place - among_closed).filter(~F.col("is_open"))
        .groupBy("_run").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), rows().alias("n_days"))
        .filter(F.col("n_days") >= min_days).drop("_run")
    )
    return runs.withColumn("near_holiday", F.abs(holiday_offset("first_day", rules)) <= 14)


def sparsity(staged: DataFrame, calendar: DataFrame) -> DataFrame:
    """How thin the sales are: articles and categories by the share of open days with a sale."""
    n_open = open_day_count(calendar)
    retail = staged.filter(retail_sale())
    sku_days = retail.groupBy("sku").agg(F.count_distinct("sale_date").alias("d"))
    category_days = retail.filter(standard_retail()).groupBy("cat_l3").agg(F.count_distinct("sale_date").alias("d"))
    skus = sku_days.withColumn("n", n_open).agg(
        F.avg(F.when(F.col("d") < 0.1 * F.col("n"), 1.0).otherwise(0.0)).alias("share_skus_below_10pct"),
        F.count_if(F.col("d") >= 0.5 * F.col("n")).alias("skus_above_50pct"))
    categories = category_days.withColumn("n", n_open).agg(F.struct(
        F.count_if(F.col("d") >= 0.5 * F.col("n")).alias("busy"), rows().alias("n")))
    return skus.withColumn("_c", categories.scalar()).select(
        "share_skus_below_10pct", "skus_above_50pct",
        F.col("_c.busy").alias("categories_above_50pct"), F.col("_c.n").alias("n_categories"))
