"""Queries for basket rules, stock-outs, data quality and report roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfcast.operators import basket, kpi, marts, quality, stockout
from shelfcast.plans.catalog import query
from shelfcast.plans.layers import Layers
from shelfcast.sources.binding import with_totals


@query("antecedent:s consequent:s support:r confidence:r lift:r n_baskets:i total_multi_item_baskets:i")
def basket_rules(t: Layers) -> DataFrame:
    return basket.basket_rules(t.staged, t.prices, t.rules)


@query("entity:s gap_start:t gap_end:t gap_open_days:i sell_day_ratio:r chance_probability:r status:s")
def stockout_suspects(t: Layers) -> DataFrame:
    return stockout.stockout_suspects(t.staged, t.calendar, t.rules)


# An article of the driver tables is sold on about one open day in eighty.
ARTICLE_SELL_RATIO = 0.01


@query("entity:s product_name:s cat_l3:s gap_start:t gap_end:t gap_open_days:i sell_day_ratio:r chance_probability:r status:s")
def stockout_articles(t: Layers) -> DataFrame:
    """Per article, with its name and category."""
    rules = t.rules.scaled(stockout_entity="sku", min_sell_ratio=ARTICLE_SELL_RATIO)
    return stockout.stockout_suspects(t.staged, t.calendar, rules)


@query("raw_lines:i staged_lines:i duplicates:i first_day:t last_day:t n_invoices:i n_skus:i revenue:d")
def dq_overview(t: Layers) -> DataFrame:
    return quality.overview(t.raw, t.staged)


@query("period_month:s file_revenue:d our_revenue:d diff:d")
def dq_reconcile_month(t: Layers) -> DataFrame:
    return quality.reconcile_months(with_totals(t.raw), t.staged)


@query("within_1:r within_100:r n_invoices:i")
def dq_reconcile_invoice(t: Layers) -> DataFrame:
    return quality.reconcile_invoices(with_totals(t.raw))


@query("issue:s n_lines:i revenue:d revenue_share:r")
def dq_issue_counts(t: Layers) -> DataFrame:
    return quality.issue_counts(t.staged)


@query("method:s n_lines:i")
def dq_cost_fill(t: Layers) -> DataFrame:
    return quality.cost_fill_counts(t.staged)


@query("n_l1:i n_l2:i n_l3:i short_path_lines:i repaired_lines:i")
def dq_category_tree(t: Layers) -> DataFrame:
    return quality.category_tree(t.raw, t.staged, t.rules)


@query("txn_channel:s n_lines:i n_invoices:i qty_share:r revenue_share:r")
def dq_channel_mix(t: Layers) -> DataFrame:
    return quality.channel_mix(t.staged)


@query("first_day:t last_day:t n_days:i near_holiday:b")
def dq_closed_runs(t: Layers) -> DataFrame:
    return quality.closed_runs(t.calendar, t.rules, min_days=1)


@query("share_skus_below_10pct:r skus_above_50pct:i categories_above_50pct:i n_categories:i")
def dq_sparsity(t: Layers) -> DataFrame:
    return quality.sparsity(t.staged, t.calendar)


@query("channel:s revenue:d profit:d n_invoices:i invoice_share:r revenue_share:r margin:r")
def kpi_channel_totals(t: Layers) -> DataFrame:
    return kpi.channel_totals(marts.monthly(t.staged, t.calendar))


@query("year_month:s inv_per_day:r basket:d")
def kpi_traffic_monthly(t: Layers) -> DataFrame:
    return kpi.traffic_monthly(marts.daily_traffic(t.staged))


@query("measure:s early:r late:r change:r")
def kpi_period_shift(t: Layers) -> DataFrame:
    return kpi.period_shift(
        marts.monthly(t.staged, t.calendar), kpi.traffic_monthly(marts.daily_traffic(t.staged)),
        marts.channel_monthly(t.staged, t.calendar, t.rules), skip=tuple(f"{day:%Y-%m}" for day in t.rules.holidays))


@query("abc_class:s n_items:i item_share:r qty_share:r revenue_share:r median_sell_day_ratio:r")
def kpi_abc_summary(t: Layers) -> DataFrame:
    return kpi.abc_summary(marts.sku_abc(t.staged, t.calendar, t.rules))


@query("kind:s slot:i value:r")
def kpi_peak_hours(t: Layers) -> DataFrame:
    return kpi.peak_hours(marts.hour_weekday(t.staged, t.calendar))


@query("quadrant:s n_categories:i revenue_share:r profit:d worst_category:s")
def kpi_quadrants(t: Layers) -> DataFrame:
    return kpi.quadrants(marts.category_margin(t.staged))


@query("cat_l2:s n_suspect:i suspect_loss:d suspect_revenue:d worst_product:s worst_qty:d worst_price:d worst_cost:d "
       "worst_profit:d")
def kpi_cost_anomaly(t: Layers) -> DataFrame:
    return kpi.cost_anomalies(t.staged)


@query("bulk_frequency:s n_skus:i n_orders:i revenue:d revenue_share:r median_bulk_share:r n_mostly_bulk:i "
       "reserve_value:d")
def kpi_bulk_summary(t: Layers) -> DataFrame:
    return kpi.bulk_summary(marts.bulk_sku(t.staged))


@query("last_28:r previous_28:r whole_span:r change:r alert:b")
def kpi_last28(t: Layers) -> DataFrame:
    return kpi.last_28_days(marts.daily_traffic(t.staged))


@query("block_start:t value:d n_days:i")
def weekly_blocks(t: Layers) -> DataFrame:
    per_day = t.daily.groupBy("date").agg(F.sum("quantity").alias("quantity"))
    return kpi.weekly_blocks(per_day, "date", "quantity", t.calendar.agg(F.max("date")).scalar())


@query("cat_l1:s n_days:i rev_per_day:d qty_factor:r rev_factor:r")
def kpi_holiday_top(t: Layers) -> DataFrame:
    return kpi.holiday_top(marts.holiday_effect(t.daily, t.rules), min_revenue_per_day=10_000)


@query("holiday:t date:t n_invoices:i revenue:d quantity:d")
def kpi_holiday_window(t: Layers) -> DataFrame:
    return kpi.days_around(marts.daily_traffic(t.staged), t.rules.holidays, before=38, after=31)


@query("year_month:s retail:d wholesale:d")
def kpi_monthly_pivot(t: Layers) -> DataFrame:
    return kpi.monthly_by_channel(marts.monthly(t.staged, t.calendar))


@query("iso_weekday:i " + " ".join(f"h{h}:r" for h in range(24)))
def kpi_heat_grid(t: Layers) -> DataFrame:
    return kpi.heat_grid(marts.hour_weekday(t.staged, t.calendar))


@query("rank:i cat_l2:s revenue:d profit:d margin:r")
def kpi_least_profitable(t: Layers) -> DataFrame:
    """The categories that earn least, as a short list."""
    return kpi.least_profitable(marts.category_margin(t.staged), 8)


@query("cat_l3:s n_parents:i")
def dq_ambiguous_level3(t: Layers) -> DataFrame:
    return marts.ambiguous_level3(t.daily)


@query("cat_l2:s revenue:d profit:d")
def kpi_loss_list(t: Layers) -> DataFrame:
    return kpi.loss_list(marts.category_margin(t.staged))
