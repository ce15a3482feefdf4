"""Queries for the analysis tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfcast.operators import marts
from shelfcast.plans.catalog import query
from shelfcast.plans.layers import Layers

MARGIN_SCHEMA = (
    "cat_l1:s cat_l2:s revenue:d profit:d retail_margin:r retail_share:r n_sku:i margin:r revenue_share:r "
    "rev_median:d store_margin:r quadrant:s"
)
AS_OF = "1999-06-30"


@query("date:t cat_l1:s cat_l2:s cat_l3:s quantity:d revenue:d profit:d n_invoices:i promo_qty_share:r discount_depth:r")
def mart_daily_category(t: Layers) -> DataFrame:
    return marts.daily_category(t.staged, t.calendar, None, t.rules)


@query("year_month:s channel:s revenue:d profit:d n_invoices:i quantity:d open_days:i revenue_per_open_day:d")
def mart_monthly(t: Layers) -> DataFrame:
    return marts.monthly(t.staged, t.calendar)


@query("sku:s product_name:s cat_l1:s cat_l3:s quantity:d revenue:d profit:d days_sold:i first_sale:t last_sale:t "
       "cum_qty_share:r qty_rank:i sell_day_ratio:r abc_class:s")
def mart_sku_abc(t: Layers) -> DataFrame:
    return marts.sku_abc(t.staged, t.calendar, t.rules)


@query("iso_weekday:i sale_hour:i avg_invoices:r avg_revenue:d n_days:i")
def mart_hour_weekday(t: Layers) -> DataFrame:
    return marts.hour_weekday(t.staged, t.calendar)


@query(MARGIN_SCHEMA)
def mart_category_margin(t: Layers) -> DataFrame:
    return marts.category_margin(t.staged)


@query(MARGIN_SCHEMA)
def category_margin_asof(t: Layers) -> DataFrame:
    return marts.category_margin(t.staged, until=AS_OF, actual_cost_only=True)


@query("cat_l1:s holiday_window:s n_days:i qty_per_day:d rev_per_day:d qty_factor:r rev_factor:r")
def mart_holiday_effect(t: Layers) -> DataFrame:
    return marts.holiday_effect(t.daily, t.rules)


@query("date:t n_invoices:i revenue:d quantity:d")
def mart_daily_traffic(t: Layers) -> DataFrame:
    return marts.daily_traffic(t.staged)


@query("sku:s product_name:s cat_l1:s cat_l3:s n_bulk_orders:i n_bulk_months:i n_data_months:i bulk_qty:d "
       "median_qty_per_order:d max_qty_per_order:d bulk_revenue:d retail_qty:d bulk_share_qty:r last_bulk_date:t "
       "bulk_frequency:s reserve_qty:d unit_cost:d reserve_value:d")
def mart_bulk_sku(t: Layers) -> DataFrame:
    return marts.bulk_sku(t.staged)


@query("ord:i metric:s value:d")
def mart_bulk_backtest(t: Layers) -> DataFrame:
    return marts.bulk_backtest(t.staged, t.rules)


@query("year_month:s open_days:i retail_inv_per_day:r retail_morning_per_day:r retail_midday_per_day:r "
       "retail_evening_per_day:r retail_inv_500k_plus:i bulk_orders:i bulk_revenue:d")
def mart_channel_monthly(t: Layers) -> DataFrame:
    return marts.channel_monthly(t.staged, t.calendar, t.rules)


@query("cat_l1:s discount_days:i avg_depth:r rel_qty_discount:r rel_qty_normal:r uplift_ratio:r uplift_per_pct:r "
       "reliable:b store_uplift_per_pct:r")
def price_response(t: Layers) -> DataFrame:
    return marts.price_response(t.daily)


@query("cat_l3:s sku:s product_name:s qty:d share:r rk:i")
def sku_share_recent(t: Layers) -> DataFrame:
    return marts.recent_sku_shares(t.staged, t.rules)


@query("cat_l3:s unit_cost:d unit_price:d basis:s")
def category_unit_price(t: Layers) -> DataFrame:
    known = marts.category_unit_price(t.staged, until=AS_OF, actual_cost_only=True)
    current = marts.category_unit_price(t.staged)
    return known.withColumn("basis", F.lit("as_of")).unionByName(current.withColumn("basis", F.lit("current")))
