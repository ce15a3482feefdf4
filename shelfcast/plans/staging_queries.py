"""Queries on raw lines and on the steps of cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfcast.operators import marts, staging
from shelfcast.plans.catalog import query
from shelfcast.plans.layers import Layers

KEY = "invoice_id:s sold_at:T sku:s"


@query(f"{KEY} loaded_at:T source_hash:s quantity:d unit_price:d unit_cost:d")
def stg_dedup_latest(t: Layers) -> DataFrame:
    return staging.dedup_latest(t.raw)


@query(f"{KEY} category_path:s")
def stg_category_fix(t: Layers) -> DataFrame:
    return t.base


@query("category_path:s cat_l1:s cat_l2:s cat_l3:s n_lines:i")
def stg_category_levels(t: Layers) -> DataFrame:
    levels = staging.category_levels(t.base)
    return levels.groupBy("category_path", "cat_l1", "cat_l2", "cat_l3").agg(marts.rows().alias("n_lines"))


@query("seller:s seller_code:s")
def stg_seller_codes(t: Layers) -> DataFrame:
    return staging.seller_codes(t.base)


@query(f"{KEY} unit_cost_filled:d cost_fill_method:s cost_missing:b")
def stg_cost_fill(t: Layers) -> DataFrame:
    return staging.fill_costs(t.base)


@query(f"{KEY} unit_cost_filled:d cost_fill_method:s is_cost_suspect:b")
def stg_cost_suspect(t: Layers) -> DataFrame:
    return staging.drop_suspect_costs(staging.fill_costs(t.base), t.rules)


@query("invoice_id:s invoice_base_id:s invoice_type:s is_edited_invoice:b n_lines:i")
def stg_invoice_attrs(t: Layers) -> DataFrame:
    lines = staging.invoice_attributes(t.base.select("invoice_id"))
    return lines.groupBy("invoice_id", "invoice_base_id", "invoice_type", "is_edited_invoice").agg(
        marts.rows().alias("n_lines"))


@query("sku:s sku_deleted:b product_name:s brand:s n_lines:i")
def stg_sku_clean(t: Layers) -> DataFrame:
    lines = staging.product_attributes(t.base.select("sku", "product_name", "brand"))
    return lines.groupBy("sku", "sku_deleted", "product_name", "brand").agg(marts.rows().alias("n_lines"))


@query("sale_date:t sale_hour:i iso_weekday:i n_lines:i")
def stg_time_attrs(t: Layers) -> DataFrame:
    lines = staging.time_attributes(t.base.select("sold_at"))
    return lines.groupBy("sale_date", "sale_hour", "iso_weekday").agg(marts.rows().alias("n_lines"))


@query(f"{KEY} line_revenue:d line_cogs:d line_profit:d")
def stg_line_money(t: Layers) -> DataFrame:
    return staging.line_money(staging.drop_suspect_costs(staging.fill_costs(t.base), t.rules))


@query("invoice_id:s sku:s is_return:b is_zero_price:b is_opening_promo:b is_fractional_qty:b is_credit_sale:b")
def stg_flags(t: Layers) -> DataFrame:
    return staging.quality_flags(staging.category_levels(staging.invoice_attributes(t.base)))


@query(f"{KEY} quantity:d prior_median_qty:d")
def stg_prior_median(t: Layers) -> DataFrame:
    return staging.prior_median_quantity(t.base, t.rules)


@query("invoice_id:s invoice_qty:d invoice_value:d")
def stg_invoice_size(t: Layers) -> DataFrame:
    return staging.invoice_size(t.base)


@query(f"{KEY} txn_channel:s")
def stg_channel(t: Layers) -> DataFrame:
    return staging.classify_channel(t.base, t.rules)


@query("sku:s month:t usual_price:d")
def stg_usual_price(t: Layers) -> DataFrame:
    return staging.usual_prices(t.staged)


@query("date:t year:i month:i year_month:s iso_weekday:i is_weekend:b n_sale_invoices:i is_open:b")
def stg_calendar(t: Layers) -> DataFrame:
    return staging.calendar(t.staged)


STAGED_SCHEMA = (
    "invoice_id:s invoice_base_id:s invoice_type:s is_edited_invoice:b sold_at:T sale_date:t sale_hour:i "
    "iso_weekday:i branch:s seller_code:s seller_active:b sku:s sku_deleted:b barcode:s product_name:s brand:s "
    "category_path:s cat_l1:s cat_l2:s cat_l3:s quantity:d unit_price:d unit_cost:d cost_missing:b note:s "
    "unit_cost_filled:d cost_fill_method:s is_cost_suspect:b line_revenue:d line_cogs:d line_profit:d "
    "is_return:b is_zero_price:b is_opening_promo:b is_fractional_qty:b is_credit_sale:b txn_channel:s"
)


@query(STAGED_SCHEMA)
def stg_sales_lines(t: Layers) -> DataFrame:
    """The full chain, not the written layer, so the query measures the work."""
    return staging.stage_lines(t.base, t.rules)
