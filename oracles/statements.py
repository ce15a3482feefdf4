"""One SQL text per query name, over the parts in `oracles.parts`."""

from __future__ import annotations

from oracles.parts import BINDING, layered, margin

R = BINDING
AS_OF = "1999-06-30"

# crc32 a bit at a time: there is no such function in DuckDB.
CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))")
SQL: dict[str, str] = {}

SQL["stg_dedup_latest"] = "SELECT * FROM o_dedup"
SQL["stg_category_fix"] = "SELECT * FROM o_repaired"
SQL["stg_category_levels"] = """
SELECT category_path, cat_l1, cat_l2, cat_l3, count(*) AS n_lines FROM o_stg GROUP BY ALL"""
SQL["stg_seller_codes"] = "SELECT * FROM o_sellers"
SQL["stg_cost_fill"] = """
SELECT invoice_id, sold_at, sku, filled AS unit_cost_filled, method AS cost_fill_method, unit_cost = 0 AS cost_missing
FROM o_costed"""
_suspect = f"coalesce(unit_price > 0 AND filled > {R.suspect_cost_ratio} * unit_price, false)"
SQL["stg_cost_suspect"] = f"""
SELECT invoice_id, sold_at, sku, CASE WHEN NOT {_suspect} THEN filled END AS unit_cost_filled,
       CASE WHEN NOT {_suspect} THEN method END AS cost_fill_method, {_suspect} AS is_cost_suspect FROM o_costed"""
SQL["stg_invoice_attrs"] = """
SELECT invoice_id, invoice_base_id, invoice_type, is_edited_invoice, count(*) AS n_lines FROM o_stg GROUP BY ALL"""
SQL["stg_sku_clean"] = "SELECT sku, sku_deleted, product_name, brand, count(*) AS n_lines FROM o_stg GROUP BY ALL"
SQL["stg_time_attrs"] = "SELECT sale_date, sale_hour, iso_weekday, count(*) AS n_lines FROM o_stg GROUP BY ALL"
SQL["stg_line_money"] = f"""
SELECT invoice_id, sold_at, sku, quantity * unit_price AS line_revenue,
       CASE WHEN NOT {_suspect} THEN quantity * filled END AS line_cogs,
       CASE WHEN NOT {_suspect} THEN quantity * (unit_price - filled) END AS line_profit FROM o_costed"""
SQL["stg_flags"] = """
SELECT invoice_id, CONCAT(sku, CASE WHEN sku_deleted THEN '{DEL}' ELSE '' END) AS sku,
       is_return, is_zero_price, is_opening_promo, is_fractional_qty, is_credit_sale FROM o_stg"""
SQL["stg_prior_median"] = "SELECT * FROM o_history"
SQL["stg_invoice_size"] = "SELECT * FROM o_invoice"
SQL["stg_channel"] = "SELECT * FROM o_channel"
SQL["stg_usual_price"] = "SELECT * FROM o_price"
SQL["stg_calendar"] = "SELECT * FROM o_cal"
SQL["stg_sales_lines"] = "SELECT * FROM o_stg"

SQL["mart_daily_category"] = "SELECT * FROM o_daily"
SQL["mart_monthly"] = "SELECT * FROM o_monthly"
SQL["mart_sku_abc"] = "SELECT * FROM o_abc"
SQL["mart_hour_weekday"] = "SELECT * FROM o_heat"
SQL["mart_category_margin"] = "SELECT * FROM o_margin"
SQL["category_margin_asof"] = margin(f"sale_date <= DATE '{AS_OF}' AND method = 'actual'")
SQL["mart_holiday_effect"] = "SELECT * FROM o_holiday_effect"
SQL["mart_daily_traffic"] = "SELECT * FROM o_traffic"
SQL["mart_bulk_sku"] = "SELECT * FROM o_bulk"
SQL["mart_bulk_backtest"] = """
SELECT v.ord, v.metric, v.value FROM o_bulk_cut c,
 (SELECT count(*) AS n, sum(reserve_qty * unit_cost) AS worth FROM o_bulk_frequent) f,
 (SELECT count(*) AS n, count(reserve_qty) AS nf, count(DISTINCT CASE WHEN reserve_qty IS NOT NULL THEN sku END) AS again,
         count(*) FILTER (WHERE qty <= reserve_qty) / CAST(nullif(count(reserve_qty), 0) AS DOUBLE) AS full_share,
         sum(CASE WHEN reserve_qty IS NOT NULL THEN least(qty, reserve_qty) END) AS cov,
         sum(CASE WHEN reserve_qty IS NOT NULL THEN qty END) AS fq, sum(qty) AS q FROM o_bulk_tested) t,
 LATERAL (SELECT unnest([
   {'ord': 1, 'metric': 'test_start', 'value': CAST(epoch(c.test_start) AS DOUBLE)},
   {'ord': 2, 'metric': 'train_months', 'value': CAST(c.train_months AS DOUBLE)},
   {'ord': 3, 'metric': 'frequent_skus', 'value': CAST(f.n AS DOUBLE)},
   {'ord': 4, 'metric': 'reserve_value', 'value': f.worth},
   {'ord': 5, 'metric': 'frequent_skus_reordered', 'value': CAST(t.again AS DOUBLE)},
   {'ord': 6, 'metric': 'test_purchases', 'value': CAST(t.n AS DOUBLE)},
   {'ord': 7, 'metric': 'test_purchases_frequent', 'value': CAST(t.nf AS DOUBLE)},
   {'ord': 8, 'metric': 'share_purchases_fully_covered', 'value': t.full_share},
   {'ord': 9, 'metric': 'share_qty_covered', 'value': t.cov / nullif(t.fq, 0)},
   {'ord': 10, 'metric': 'share_bulk_qty_of_frequent', 'value': t.fq / t.q}], recursive := true)) v"""
SQL["mart_channel_monthly"] = f"""
SELECT i.ym AS year_month, o.open_days,
       count(*) FILTER (WHERE ch = 'retail') / CAST(o.open_days AS DOUBLE) AS retail_inv_per_day,
       count(*) FILTER (WHERE ch = 'retail' AND hr <= 11) / CAST(o.open_days AS DOUBLE) AS retail_morning_per_day,
       count(*) FILTER (WHERE ch = 'retail' AND hr >= 12 AND hr <= 15) / CAST(o.open_days AS DOUBLE) AS retail_midday_per_day,
       count(*) FILTER (WHERE ch = 'retail' AND hr > 15) / CAST(o.open_days AS DOUBLE) AS retail_evening_per_day,
       count(*) FILTER (WHERE ch = 'retail' AND v >= {R.large_retail_invoice}) AS retail_inv_500k_plus,
       count(*) FILTER (WHERE ch IN ('bulk', 'organization')) AS bulk_orders,
       sum(v) FILTER (WHERE ch IN ('bulk', 'organization')) AS bulk_revenue
FROM (SELECT invoice_id, min(txn_channel) AS ch, strftime(min(sale_date), '%Y-%m') AS ym, min(sale_hour) AS hr,
             sum(line_revenue) AS v FROM o_stg WHERE NOT is_return GROUP BY invoice_id) i
JOIN o_month_open o ON o.year_month = i.ym GROUP BY i.ym, o.open_days"""
SQL["price_response"] = "SELECT * FROM o_price_response"
SQL["sku_share_recent"] = f"""
SELECT cat_l3, sku, name AS product_name, qty, share, rk FROM (
  SELECT *, qty / sum(qty) OVER (PARTITION BY cat_l3) AS share,
         rank() OVER (PARTITION BY cat_l3 ORDER BY qty DESC, sku) AS rk
  FROM (SELECT cat_l3, sku, max(product_name) AS name, sum(quantity) AS qty FROM o_sold
        WHERE NOT is_zero_price AND date_diff('day', sale_date, (SELECT max(sale_date) FROM o_stg)) < {R.share_days}
        GROUP BY cat_l3, sku))
WHERE rk <= {R.top_skus}"""
SQL["category_unit_price"] = f"""
SELECT cat_l3, 'as_of' AS basis, sum(quantity * unit_cost) / sum(quantity) AS unit_cost,
       sum(line_revenue) / sum(quantity) AS unit_price
FROM o_stg WHERE txn_channel = 'retail' AND quantity > 0 AND NOT is_zero_price AND cost_fill_method = 'actual'
  AND sale_date <= DATE '{AS_OF}' GROUP BY cat_l3
UNION ALL
SELECT cat_l3, 'current', sum(quantity * unit_cost_filled) / sum(quantity), sum(line_revenue) / sum(quantity)
FROM o_stg WHERE txn_channel = 'retail' AND quantity > 0 AND cost_fill_method IS NOT NULL GROUP BY cat_l3"""

# --- entry and export ------------------------------------------------------------------
SQL["src_header_map"] = """
SELECT invoice_id, sold_at, sku, product_name, category_path, quantity, unit_price, unit_cost,
       CAST(NULL AS VARCHAR) AS brand, CAST(NULL AS DOUBLE) AS month_revenue FROM o_raw"""
SQL["src_read_canonical"] = "SELECT * FROM o_raw"
# The same share of invoices as the files of another program, which lack these two columns.
SQL["src_read_mixed_headers"] = f"""
SELECT * REPLACE (CASE WHEN {CRC32.format('invoice_id')} % 4 <> 3 THEN branch END AS branch,
                  CASE WHEN {CRC32.format('invoice_id')} % 4 <> 3 THEN seller END AS seller) FROM o_raw"""
SQL["src_store_reload"] = """
SELECT source_hash, strftime(sold_at, '%Y-%m') AS sold_month, count(*) AS n_lines, sum(quantity) AS quantity,
       source_hash = 'b2' AS rewritten FROM o_raw GROUP BY ALL"""
SQL["src_coerce_types"] = """
SELECT CASE WHEN invoice_id LIKE '%77' THEN 'quarantined' ELSE 'good' END AS status, count(*) AS n_lines,
       sum(CASE WHEN invoice_id NOT LIKE '%77' THEN quantity END) AS quantity FROM o_raw GROUP BY 1"""
SQL["src_idempotent_load"] = """
SELECT source_hash, CASE WHEN source_hash = 'b2' THEN loaded_at + INTERVAL 1 DAY ELSE loaded_at END AS loaded_at,
       count(*) AS n_lines, sum(quantity) AS quantity FROM o_raw GROUP BY ALL"""
SQL["sink_pii_guard"] = "SELECT * FROM o_monthly"

# --- baskets and stock-outs --------------------------------------------------------------
SQL["basket_rules"] = f"""
SELECT * FROM (
  SELECT CASE WHEN swap THEN y ELSE x END AS antecedent, CASE WHEN swap THEN x ELSE y END AS consequent,
         n / total AS support, n / CAST(least(nx, ny) AS DOUBLE) AS confidence, n * total / (nx * ny) AS lift,
         n AS n_baskets, total AS total_multi_item_baskets
  FROM (SELECT p.*, i.n AS nx, j.n AS ny, (SELECT CAST(count(DISTINCT invoice_id) AS DOUBLE) FROM o_basket) AS total,
               (j.n < i.n OR (j.n = i.n AND y < x)) AS swap
        FROM (SELECT a.item AS x, b.item AS y, count(*) AS n FROM o_basket a JOIN o_basket b
              ON a.invoice_id = b.invoice_id AND a.item < b.item GROUP BY 1, 2) p
        JOIN o_basket_item i ON i.item = x JOIN o_basket_item j ON j.item = y))
WHERE support >= {R.min_support} AND lift >= {R.min_lift}"""
def _stockouts(days: str) -> str:
    return f"""
SELECT * FROM (
  SELECT g.entity, d0.date AS gap_start, d1.date AS gap_end, g.gap AS gap_open_days, g.ratio AS sell_day_ratio,
         pow(1 - g.ratio, g.gap) AS chance_probability,
         CASE WHEN g.nxt > (SELECT n FROM o_open) THEN 'Không bán tới cuối kỳ: hết hàng hoặc đã ngừng bán'
              ELSE 'Nghi ngờ hết hàng' END AS status
  FROM (SELECT entity, place, nxt, nxt - place - 1 AS gap,
               count(*) OVER (PARTITION BY entity) / CAST((SELECT n FROM o_open) + 1 - min(place) OVER (PARTITION BY entity) AS DOUBLE) AS ratio
        FROM (SELECT *, lead(place, 1, (SELECT n FROM o_open) + 1) OVER (PARTITION BY entity ORDER BY place) AS nxt
              FROM {days})) g
  JOIN o_open_place d0 ON d0.place = g.place + 1 JOIN o_open_place d1 ON d1.place = g.nxt - 1
  WHERE g.gap >= {R.min_gap})
WHERE chance_probability < {R.max_gap_probability}"""


SQL["stockout_suspects"] = _stockouts("o_entity_days")
SQL["stockout_articles"] = f"SELECT * FROM ({_stockouts('o_article_days')}) JOIN o_article_names USING (entity)"

# --- data quality ------------------------------------------------------------------------
SQL["dq_overview"] = """
SELECT r.n AS raw_lines, count(*) AS staged_lines, r.n - count(*) AS duplicates, min(sale_date) AS first_day,
       max(sale_date) AS last_day, count(DISTINCT invoice_id) AS n_invoices, count(DISTINCT sku) AS n_skus,
       sum(line_revenue) AS revenue FROM o_stg, (SELECT count(*) AS n FROM o_raw) r GROUP BY r.n"""
SQL["dq_reconcile_month"] = """
SELECT f.period_month, f.v AS file_revenue, o.v AS our_revenue, o.v - f.v AS diff
FROM (SELECT period_month, sum(quantity * unit_price) AS v FROM o_raw WHERE source_hash = 'b1' GROUP BY 1) f
JOIN (SELECT strftime(sale_date, '%m-%Y') AS period_month, sum(line_revenue) AS v FROM o_stg GROUP BY 1) o
  ON o.period_month = f.period_month"""
SQL["dq_reconcile_invoice"] = """
SELECT avg(CASE WHEN gap <= 1 THEN 1 ELSE 0 END) AS within_1, avg(CASE WHEN gap <= 100 THEN 1 ELSE 0 END) AS within_100,
       count(*) AS n_invoices
FROM (SELECT abs(sum(quantity * unit_price) - sum(CASE WHEN source_hash = 'b1' THEN quantity * unit_price END)) AS gap
      FROM o_raw GROUP BY invoice_id)"""
_issues = {
    "return": "is_return", "edited_invoice": "is_edited_invoice", "cost_missing": "cost_missing",
    "zero_price": "is_zero_price", "opening_promo": "is_opening_promo", "fractional_quantity": "is_fractional_qty",
    "unknown_brand": "brand = 'Không rõ'", "deleted_sku": "sku_deleted", "cost_suspect": "is_cost_suspect",
    "credit_sale": "is_credit_sale"}
SQL["dq_issue_counts"] = " UNION ALL ".join(
    f"SELECT '{k}' AS issue, count(*) FILTER (WHERE {c}) AS n_lines, coalesce(sum(line_revenue) FILTER (WHERE {c}), 0) AS revenue, "
    f"abs(sum(line_revenue) FILTER (WHERE {c})) / sum(line_revenue) AS revenue_share FROM o_stg" for k, c in _issues.items())
SQL["dq_cost_fill"] = """
SELECT coalesce(cost_fill_method, 'không điền được') AS method, count(*) AS n_lines FROM o_stg WHERE cost_missing GROUP BY 1"""
_bad_paths = ", ".join(f"'{p}'" for p in R.category_fixes)
SQL["dq_category_tree"] = f"""
SELECT count(DISTINCT cat_l1) AS n_l1, count(DISTINCT cat_l2) AS n_l2, count(DISTINCT cat_l3) AS n_l3,
       count(*) FILTER (WHERE len(string_split(category_path, '>>')) < 3) AS short_path_lines,
       (SELECT count(*) FROM o_raw WHERE category_path IN ({_bad_paths})) AS repaired_lines FROM o_stg"""
SQL["dq_channel_mix"] = """
SELECT txn_channel, count(*) AS n_lines, count(DISTINCT invoice_id) AS n_invoices,
       sum(quantity) / (SELECT sum(quantity) FROM o_stg) AS qty_share,
       sum(line_revenue) / (SELECT sum(line_revenue) FROM o_stg) AS revenue_share FROM o_stg GROUP BY txn_channel"""
SQL["dq_closed_runs"] = """
SELECT first_day, last_day, n_days, abs(off) <= 14 AS near_holiday FROM (
  SELECT min(date) AS first_day, max(date) AS last_day, count(*) AS n_days
  FROM (SELECT date, date - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS anchor FROM o_cal WHERE NOT is_open)
  GROUP BY anchor) JOIN o_offset ON date = first_day"""
SQL["dq_sparsity"] = """
SELECT s.a AS share_skus_below_10pct, s.b AS skus_above_50pct, c.b AS categories_above_50pct, c.n AS n_categories
FROM (SELECT avg(CASE WHEN d < CAST(0.1 AS DOUBLE) * n THEN 1 ELSE 0 END) AS a, count(*) FILTER (WHERE d >= CAST(0.5 AS DOUBLE) * n) AS b
      FROM (SELECT sku, count(DISTINCT sale_date) AS d FROM o_sold GROUP BY sku), o_open) s,
     (SELECT count(*) FILTER (WHERE d >= CAST(0.5 AS DOUBLE) * o.n) AS b, count(*) AS n
      FROM (SELECT cat_l3, count(DISTINCT sale_date) AS d FROM o_std GROUP BY cat_l3), o_open o) c"""

# --- roll-ups ------------------------------------------------------------------------------
SQL["kpi_channel_totals"] = """
SELECT channel, sum(revenue) AS revenue, sum(profit) AS profit, sum(n_invoices) AS n_invoices,
       sum(n_invoices) / CAST(sum(sum(n_invoices)) OVER () AS DOUBLE) AS invoice_share,
       sum(revenue) / sum(sum(revenue)) OVER () AS revenue_share, sum(profit) / sum(revenue) AS margin
FROM o_monthly GROUP BY channel"""
SQL["kpi_traffic_monthly"] = "SELECT * FROM o_traffic_month"
_shift = {
    "revenue_per_open_day": "m.revenue_per_open_day", "inv_per_day": "x.inv_per_day", "basket": "x.basket",
    "retail_morning_per_day": "c.retail_morning_per_day", "retail_midday_per_day": "c.retail_midday_per_day",
    "retail_evening_per_day": "c.retail_evening_per_day", "bulk_orders": "c.bulk_orders",
    "retail_inv_500k_plus": "c.retail_inv_500k_plus"}
_shift_rows = " UNION ALL ".join(
    f"SELECT '{k}' AS measure, avg(CASE WHEN NOT late THEN {v} END) AS early, avg(CASE WHEN late THEN {v} END) AS late_mean FROM joined"
    for k, v in ((k, v.split(".")[1]) for k, v in _shift.items()))
SQL["kpi_period_shift"] = f"""
SELECT measure, early, late_mean AS late, late_mean / early - 1 AS change FROM (
  WITH joined AS (
    SELECT m.revenue_per_open_day, x.inv_per_day, x.basket, c.*, rank() OVER (ORDER BY m.year_month DESC) <= 2 AS late
    FROM o_monthly m JOIN o_traffic_month x ON x.year_month = m.year_month
    JOIN ({SQL["mart_channel_monthly"]}) c ON c.year_month = m.year_month
    WHERE m.channel = 'Bán lẻ' AND m.year_month NOT IN ('1996-02', '1997-02', '1998-02', '1999-02', '2000-02', '2001-02'))
  {_shift_rows})"""
SQL["kpi_abc_summary"] = """
SELECT abc_class, count(*) AS n_items, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM o_abc) AS item_share,
       sum(quantity) / (SELECT sum(quantity) FROM o_abc) AS qty_share,
       sum(revenue) / (SELECT sum(revenue) FROM o_abc) AS revenue_share,
       quantile_cont(sell_day_ratio, 0.5) AS median_sell_day_ratio FROM o_abc GROUP BY abc_class"""
SQL["kpi_peak_hours"] = """
WITH h AS (SELECT sale_hour, avg(avg_invoices) AS v FROM o_heat GROUP BY sale_hour),
     q AS (SELECT *, rank() OVER (ORDER BY v DESC, sale_hour) AS place FROM h)
SELECT CASE place WHEN 1 THEN 'peak' ELSE 'second_peak' END AS kind, sale_hour AS slot, v AS value FROM q WHERE place < 4
UNION ALL (SELECT 'trough', sale_hour, v FROM h WHERE sale_hour BETWEEN 12 AND 15 ORDER BY v, sale_hour LIMIT 1)
UNION ALL SELECT 'weekday', iso_weekday, sum(avg_invoices) FROM o_heat GROUP BY iso_weekday"""
SQL["kpi_quadrants"] = """
SELECT quadrant, count(*) AS n_categories, sum(revenue_share) AS revenue_share, sum(profit) AS profit,
       arg_min(cat_l2, profit) AS worst_category FROM o_margin GROUP BY quadrant"""
SQL["kpi_cost_anomaly"] = """
SELECT w.*, coalesce(s.n, 0) AS n_suspect, s.loss AS suspect_loss, s.rev AS suspect_revenue
FROM (SELECT DISTINCT ON (cat_l2) cat_l2, product_name AS worst_product, qty AS worst_qty, price AS worst_price,
             cost AS worst_cost, round(profit, 4) AS worst_profit
      FROM (SELECT cat_l2, product_name, sum(line_profit) AS profit, sum(quantity) AS qty,
                   quantile_cont(unit_price, 0.5) AS price, quantile_cont(unit_cost_filled, 0.5) AS cost
            FROM o_stg WHERE cost_fill_method IS NOT NULL GROUP BY 1, 2)
      ORDER BY cat_l2, round(profit, 4), product_name) w
LEFT JOIN (SELECT cat_l2, count(*) AS n, sum(quantity * (unit_price - unit_cost)) AS loss, sum(line_revenue) AS rev
           FROM o_stg WHERE is_cost_suspect GROUP BY cat_l2) s ON s.cat_l2 = w.cat_l2"""
SQL["kpi_bulk_summary"] = """
SELECT bulk_frequency, count(*) AS n_skus, sum(n_bulk_orders) AS n_orders, sum(bulk_revenue) AS revenue,
       sum(bulk_revenue) / (SELECT sum(bulk_revenue) FROM o_bulk) AS revenue_share,
       quantile_cont(bulk_share_qty, 0.5) AS median_bulk_share, count(*) FILTER (WHERE bulk_share_qty > 0.5) AS n_mostly_bulk,
       sum(reserve_value) AS reserve_value FROM o_bulk GROUP BY bulk_frequency"""
SQL["kpi_last28"] = """
SELECT a AS last_28, b AS previous_28, c AS whole_span, a / b - 1 AS change, a / c < CAST(0.85 AS DOUBLE) AS alert FROM (
  SELECT avg(n_invoices) FILTER (WHERE date > last - 28) AS a,
         avg(n_invoices) FILTER (WHERE date <= last - 28 AND date > last - 56) AS b, avg(n_invoices) AS c
  FROM o_traffic, (SELECT max(date) AS last FROM o_traffic))"""
SQL["weekly_blocks"] = """
SELECT last - CAST(7 * k + 6 AS INTEGER) AS block_start, sum(quantity) AS value, count(DISTINCT date) AS n_days
FROM (SELECT *, (last - date) // 7 AS k FROM o_daily, (SELECT max(date) AS last FROM o_cal)) GROUP BY k, last"""
SQL["kpi_holiday_top"] = """
SELECT * FROM o_holiday_effect WHERE holiday_window = 'Trước Tết' AND cat_l1 <> 'Toàn cửa hàng' AND rev_per_day > 10000"""
SQL["kpi_holiday_window"] = """
SELECT g.holiday, g.day AS date, t.n_invoices, t.revenue, t.quantity
FROM (SELECT holiday, CAST(unnest(generate_series(holiday - 38, holiday + 31, INTERVAL 1 DAY)) AS DATE) AS day FROM o_holidays) g
LEFT JOIN o_traffic t ON t.date = g.day"""

# --- series ------------------------------------------------------------------------------
SQL["ts_dense"] = "SELECT * FROM o_series"
SQL["ts_holiday_offset"] = "SELECT * FROM o_offset"
SQL["ts_impute"] = "SELECT * FROM o_imputed"
SQL["ts_sample"] = """
SELECT unique_id, ds, y, is_imputed FROM o_imputed
ORDER BY md5('sample|=' || unique_id || '|=' || strftime(ds, '%Y-%m-%d')), unique_id, ds LIMIT 2000"""
SQL["ts_demand_class"] = "SELECT * FROM o_profile"
SQL["ts_features"] = """
SELECT *, CASE WHEN n7 = 7 THEN m7 END AS rolling_mean_7, CASE WHEN n28 = 28 THEN m28 END AS rolling_mean_28,
       CASE WHEN n28 = 28 THEN s28 END AS rolling_std_28, CASE WHEN nb = 28 THEN mb END AS rolling_mean_28_lag7
FROM (SELECT *, lag(y, 1) OVER s AS lag1, lag(y, 2) OVER s AS lag2, lag(y, 3) OVER s AS lag3, lag(y, 7) OVER s AS lag7,
             lag(y, 14) OVER s AS lag14, lag(y, 21) OVER s AS lag21, lag(y, 28) OVER s AS lag28,
             avg(y) OVER a AS m7, count(y) OVER a AS n7, avg(y) OVER b AS m28, count(y) OVER b AS n28, stddev_samp(y) OVER b AS s28,
             avg(y) OVER c AS mb, count(y) OVER c AS nb, avg(y) OVER e AS expanding_mean,
             isodow(ds) - 1 AS dayofweek, date_part('day', ds) AS day
      FROM o_imputed
      WINDOW s AS (PARTITION BY unique_id ORDER BY ds), a AS (s ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
             b AS (s ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), c AS (s ROWS BETWEEN 34 PRECEDING AND 7 PRECEDING),
             e AS (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
SQL["ts_walk_forward"] = f"""
SELECT i.unique_id, i.ds, c.cutoff, c.n AS "window", CASE WHEN c.n <= {R.n_selection} THEN 'selection' ELSE 'holdout' END AS phase,
       i.y_raw, i.is_closed
FROM o_imputed i JOIN (SELECT cutoff, rank() OVER (ORDER BY cutoff) AS n FROM o_cut) c ON i.ds - c.cutoff BETWEEN 1 AND {R.horizon}"""

# --- forecasts ------------------------------------------------------------------------------
for _name, _model in (("fc_historic_average", "HistoricAverage"), ("fc_moving_avg28", "MovingAvg28"),
                      ("fc_seasonal_naive", "SeasonalNaive"), ("fc_tsb", "TSB")):
    SQL[_name] = f"SELECT * FROM o_native WHERE model = '{_model}'"
_ahead = f"range(1, {R.horizon + 1}) r(step)"
for _name, _model in (("fc_croston", "Croston"), ("fc_adida", "ADIDA"), ("fc_imapa", "IMAPA"), ("fc_ets", "AutoETS")):
    SQL[_name] = f"SELECT * FROM o_stat WHERE model = '{_model}'"
SQL["fc_future"] = "SELECT * FROM o_stat_now"
SQL["fc_ensembles_gap"] = f"""
SELECT unique_id, cutoff, cutoff + CAST(step AS INTEGER) AS ds, model, 0 AS gap FROM o_hist, {_ahead},
(VALUES ('Ens_Tweedie_IMAPA'), ('Ens_Tweedie_ETS_IMAPA'), ('Ens_Tweedie_IMAPA_MA')) m(model)"""
# The intercept, twelve lag features, six weekdays, the day of the month, and a mark per category but the first.
SQL["fc_learner_score"] = """
SELECT place, 0 AS gap FROM (SELECT unnest(range(0, 19 + n)) AS place FROM (
  SELECT count(DISTINCT p.cat_l1) AS n FROM (SELECT DISTINCT unique_id FROM o_hist_now) JOIN o_profile p USING (unique_id)))"""
for _name in ("xp_local_gap", "xp_waterfall_gap"):
    SQL[_name] = f"""
SELECT unique_id, cutoff + CAST(step AS INTEGER) AS ds, 0 AS gap FROM o_hist_now, range(1, {R.horizon + 1}) r(step)"""
SQL["fc_fallback56"] = f"""
SELECT unique_id, last AS cutoff, last + CAST(step AS INTEGER) AS ds, 'TB 8 tuần (chưa đủ dữ liệu)' AS model, yhat
FROM (SELECT unique_id, last, coalesce(avg(y_raw) FILTER (WHERE last - ds < {R.share_days}), 0) AS yhat
      FROM o_imputed, o_last WHERE NOT is_closed GROUP BY 1, 2 HAVING count(*) FILTER (WHERE y_raw > 0) < 1300),
range(1, {R.long_horizon + 1}) r(step)"""

# --- scoring -----------------------------------------------------------------------------------
SQL["ev_weekly"] = 'SELECT *, win AS "window" FROM o_weeks'
SQL["ev_metrics"] = "SELECT * FROM o_metrics"
SQL["ev_tracking_signal"] = """
SELECT unique_id, model, CASE WHEN avg(abs(yhat - y)) = 0 THEN 0 ELSE sum(yhat - y) / avg(abs(yhat - y)) END AS tracking_signal
FROM o_hold GROUP BY unique_id, model"""
SQL["ev_dm_stat"] = f"""
SELECT compared_to, n AS n_days, m AS mean_diff, better AS share_days_better,
       m / sqrt(CASE WHEN lrv > 0 THEN lrv ELSE g0 END / n) * sqrt((n + 1 - {2 * R.horizon} + {R.horizon * (R.horizon - 1)} / CAST(n AS DOUBLE)) / n) AS dm_stat
FROM (SELECT l.compared_to, l.n, l.m, l.better, sum(CASE WHEN k = 0 THEN g ELSE 2 * g END) / l.n AS lrv, max(CASE WHEN k = 0 THEN g END) / l.n AS g0
      FROM (SELECT compared_to, count(*) AS n, avg(d) AS m, avg(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS better FROM o_loss_days GROUP BY 1) l
      JOIN o_gamma g ON g.compared_to = l.compared_to GROUP BY 1, 2, 3, 4)"""
SQL["ev_wilcoxon"] = """
SELECT compared_to, n AS n_series, md AS mean_abs_err_diff, better AS share_series_better, w AS w_stat,
       (w - n * (n + 1) / CAST(4 AS DOUBLE)) / sqrt(n * (n + 1) * (2 * n + 1) / CAST(24 AS DOUBLE) - t / CAST(48 AS DOUBLE)) AS z_stat
FROM (SELECT compared_to, count(*) AS n, avg(d) AS md, avg(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS better, sum(ties * ties - 1) AS t,
             least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS w FROM o_signed GROUP BY 1)"""
_cells = 20000
_normal_p = f"""1 - sqrt(2 / pi()) * abs(z_stat) / {_cells}
    * list_sum(list_transform(range({_cells}), lambda i: exp(-pow((i + 0.5) * abs(z_stat) / {_cells}, 2) / 2)))"""
_student_p = f"""1 - 2 * exp(lgamma(n_days / CAST(2 AS DOUBLE)) - lgamma((n_days - 1) / CAST(2 AS DOUBLE))) / sqrt((n_days - 1) * pi()) * abs(dm_stat) / {_cells}
    * list_sum(list_transform(range({_cells}), lambda i: pow(1 + pow((i + 0.5) * abs(dm_stat) / {_cells}, 2) / (n_days - 1), -n_days / CAST(2 AS DOUBLE))))"""
# The ways to reach each sum s of the ranks 1 to n.
_ways = """(WITH RECURSIVE ways(n, s, c) AS (
  SELECT 0, 0, CAST(1 AS DOUBLE) UNION ALL
  SELECT n + 1, s + step, sum(c) FROM (SELECT n, s, c, unnest([0, n + 1]) AS step FROM ways WHERE n < 50) GROUP BY n, s + step)
SELECT * FROM ways)"""
SQL["ev_significance"] = f"""
SELECT (SELECT model FROM o_champion) AS model, compared_to, n_series, mean_abs_err_diff, share_series_better, w_stat, z_stat,
       CASE WHEN n_series <= 50 AND compared_to NOT IN (SELECT compared_to FROM o_signed WHERE ties > 1)
            THEN least(1, 2 * (SELECT sum(c) FROM {_ways} WHERE n = n_series AND s <= w_stat) / pow(2, n_series))
            ELSE {_normal_p} END AS wilcoxon_p, n_days, share_days_better, dm_stat, {_student_p} AS dm_p
FROM ({SQL["ev_wilcoxon"]}) JOIN ({SQL["ev_dm_stat"]}) USING (compared_to)"""
SQL["ev_champion"] = "SELECT * FROM o_champion"
SQL["ev_levels"] = "SELECT * FROM o_levels"
SQL["ev_per_series"] = "SELECT * FROM o_report"
SQL["ev_confidence"] = "SELECT * FROM o_report"
SQL["ev_run_summary"] = """
SELECT c.model AS champion, a."WMAPE" AS holdout_wmape, b."WMAPE" AS baseline_wmape, l."WMAPE" AS store_wmape,
       r.share AS share_improved, p.n AS n_series, p.m AS n_modelled, r.n AS n_backtest,
       (SELECT last FROM o_last) AS data_until, (SELECT min(cutoff) FROM o_cut) AS first_cutoff, (SELECT cut FROM o_start) AS holdout_cutoff
FROM o_champion c JOIN o_metrics a ON a.model = c.model AND a.scope = 'Tổng thể'
JOIN o_metrics b ON b.model = 'HistoricAverage' AND b.scope = 'Tổng thể'
JOIN o_levels l ON l.model = c.model AND l.level = 'Toàn cửa hàng',
(SELECT avg(CASE WHEN improved THEN 1 ELSE 0 END) AS share, count(*) AS n FROM o_report) r,
(SELECT count(*) AS n, count(*) FILTER (WHERE demand_class <> 'insufficient') AS m FROM o_profile) p"""
SQL["kpi_model_compare"] = """
SELECT *, rank() OVER (ORDER BY wmape_selection) AS rank_selection, rank() OVER (ORDER BY wmape_holdout) AS rank_holdout
FROM (SELECT model, max("WMAPE") FILTER (WHERE scope = 'Giai đoạn chọn mô hình') AS wmape_selection,
             max("WMAPE") FILTER (WHERE scope = 'Tổng thể') AS wmape_holdout FROM o_metrics GROUP BY model)"""
SQL["kpi_class_by_model"] = "SELECT model, " + ", ".join(
    f"max(\"WMAPE\") FILTER (WHERE scope = '{c}') AS {c}" for c in ("smooth", "erratic", "intermittent", "lumpy")
) + " FROM o_metrics WHERE scope IN ('smooth', 'erratic', 'intermittent', 'lumpy') GROUP BY model"
SQL["kpi_class_mix"] = """
SELECT demand_class, count(*) AS n_series, sum(total_qty) / (SELECT sum(total_qty) FROM o_profile) AS qty_share FROM o_profile GROUP BY 1"""
SQL["kpi_biased_series"] = """
SELECT count(*) FILTER (WHERE abs(tracking_signal) > 4) AS n_biased, count(*) FILTER (WHERE tracking_signal > 4) AS n_high,
       count(*) FILTER (WHERE tracking_signal < -4) AS n_low FROM o_report"""

# --- orders ----------------------------------------------------------------------------------------
SQL["pol_ratio_quantiles"] = "SELECT * FROM o_ratio"
SQL["pol_horizon_quantiles"] = "SELECT * FROM o_quantiles"
SQL["pol_service_class"] = "SELECT * FROM o_service"
SQL["pol_holiday_layer"] = layered("""(
  SELECT unique_id, DATE '2001-01-31' + CAST(step AS INTEGER) AS ds, m.model, m.yhat
  FROM (SELECT unique_id, avg(y) AS a, avg(y) FILTER (WHERE ds > DATE '2001-01-31' - 28) AS b, list(y ORDER BY ds) AS ys
        FROM o_known_now WHERE ds <= DATE '2001-01-31' GROUP BY 1), range(1, 29) r(step),
  LATERAL (SELECT unnest([{'model': 'HistoricAverage', 'yhat': a}, {'model': 'MovingAvg28', 'yhat': b},
    {'model': 'SeasonalNaive', 'yhat': ys[len(ys) - 6 + CAST((step - 1) % 7 AS INTEGER)]}], recursive := true)) m)""")
SQL["pol_order_plan"] = "SELECT * FROM o_plan"
SQL["pol_sku_allocation"] = f"""
SELECT cat AS cat_l2, sku, product_name, qty, share, order_qty, forecast_week * share AS sku_forecast_week,
       whole + CASE WHEN row_number() OVER (PARTITION BY cat ORDER BY round(raw - whole, 9) DESC, sku)
                         <= round(order_qty - sum(whole) OVER (PARTITION BY cat)) THEN 1 ELSE 0 END AS sku_order_qty
FROM (SELECT *, floor(raw) AS whole FROM (
  SELECT t.*, p.order_qty, p.forecast_week, qty / sum(qty) OVER (PARTITION BY cat) AS share,
         round(p.order_qty * (qty / sum(qty) OVER (PARTITION BY cat)), 9) AS raw
  FROM o_top t JOIN o_plan p ON p.unique_id = t.cat))"""
SQL["pol_backtest_single"] = "SELECT * FROM o_single"
SQL["kpi_plan_totals"] = f"""
SELECT t.v AS total_value, t.n AS n_ordered, rank() OVER (ORDER BY order_qty DESC, unique_id) AS top_rank, unique_id, order_qty,
       forecast_week, order_value, confidence
FROM o_plan, (SELECT sum(order_value) AS v, count(*) FILTER (WHERE order_qty > 0) AS n FROM o_plan) t
QUALIFY top_rank <= {R.top_skus}"""
SQL["sink_order_plan"] = """
SELECT * REPLACE (round(order_value) AS order_value) FROM o_plan WHERE service_class <> 'Dễ hư hỏng'"""

# --- monitoring ---------------------------------------------------------------------------------------
SQL["snap_backfill"] = "SELECT * FROM o_replay"
SQL["snap_upsert"] = """
SELECT * REPLACE (CASE WHEN data_until = (SELECT max(cutoff) FROM o_cut) THEN 'corrected' ELSE run_id END AS run_id,
                  CASE WHEN data_until = (SELECT max(cutoff) FROM o_cut) THEN forecast_week + 1 ELSE forecast_week END AS forecast_week)
FROM o_replay"""
SQL["mon_snapshot_eval"] = "SELECT * FROM o_runs"
SQL["mon_drift"] = "SELECT * FROM o_drift"
SQL["mon_retrain"] = f"""
SELECT last AS data_until, {R.horizon} AS new_days, d.f AS drifted, true AS retrain
FROM o_last, (SELECT flagged AS f FROM o_drift WHERE is_latest) d"""
SQL["mon_accuracy"] = """
SELECT kind, count(*) AS n_weeks, 1 - sum(abs(forecast_total - actual_total)) / sum(actual_total) AS accuracy FROM o_runs GROUP BY kind"""

# --- what-ifs --------------------------------------------------------------------------------------------
SQL["sc_discount"] = """
SELECT cat_l1, slope, 1 + slope * 5 AS net_factor, w AS base_week, w * (1 + slope * 5) AS scenario_week,
       greatest(q * slope * 5, 0) AS extra_order
FROM (SELECT p.cat_l1, sum(p.forecast_week) AS w, sum(p.order_qty) AS q,
             any_value(CASE WHEN r.reliable THEN r.uplift_per_pct ELSE r.store_uplift_per_pct END) AS slope
      FROM o_plan p JOIN o_price_response r ON r.cat_l1 = p.cat_l1 GROUP BY p.cat_l1)"""
SQL["sc_holiday"] = """
SELECT cat_l1, f AS qty_factor, 2 * w AS normal_two_weeks, 2 * w * f AS before_holiday, w / 7 * 3 * 0.5 AS stock_up,
       2 * w * f + w / 7 * 3 * 0.5 AS total
FROM (SELECT p.cat_l1, sum(p.forecast_week) AS w, coalesce(any_value(x.qty_factor), 1) AS f FROM o_plan p
      LEFT JOIN o_factors x ON x.cat_l1 = p.cat_l1 AND x.holiday_window = 'Trước Tết' GROUP BY p.cat_l1)"""

# --- streams end in the same tables as the batch jobs ---------------------------------------
SQL["stream_ingest_dedup"] = "SELECT * FROM o_dedup"
SQL["stream_daily_traffic"] = "SELECT * FROM o_traffic"
SQL["stream_late_lines"] = """
SELECT s.sale_date AS date, count(*) FILTER (WHERE NOT late) AS kept_lines, count(*) FILTER (WHERE late) AS late_lines,
       coalesce(sum(line_revenue) FILTER (WHERE NOT late), 0) AS kept_revenue,
       coalesce(sum(line_revenue) FILTER (WHERE late), 0) AS late_revenue
FROM (SELECT sale_date, line_revenue,
             invoice_id LIKE '%7' AND sale_date + INTERVAL 93 DAY <= (SELECT max(sold_at) FROM o_stg WHERE invoice_id NOT LIKE '%7') AS late
      FROM o_sold) s GROUP BY s.sale_date"""
SQL["stream_reconcile"] = "SELECT * FROM o_drift"

SQL["pol_backtest_carry"] = "SELECT * FROM o_carry"
_components = ("units_ordered", "units_short", "units_excess", "excess_value", "lost_profit", "holding_cost", "total_cost")
SQL["kpi_policy_change"] = """
SELECT n.mode, n.component, n.value AS new, o.value AS old, n.value / nullif(o.value, 0) - 1 AS change
FROM (SELECT mode, policy, component, value FROM o_parts WHERE policy = 'quantile') n
JOIN (SELECT * FROM o_parts WHERE policy = 'moving_average') o ON o.mode = n.mode AND o.component = n.component""".replace(
    "o_parts", "(" + " UNION ALL ".join(
        [f"SELECT mode, policy, '{c}' AS component, CAST({c} AS DOUBLE) AS value FROM o_carry" for c in _components]
        + [f"SELECT mode, policy, '{c}', CAST({c if c in _components[:4] else 'NULL'} AS DOUBLE) FROM o_single" for c in _components]) + ")")
SQL["kpi_series_view"] = """
SELECT unique_id, last - CAST(7 * k + 6 AS INTEGER) AS block_start, 'actual' AS kind, sum(y_raw) AS value,
       CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper
FROM (SELECT *, (last - ds) // 7 AS k FROM o_imputed, o_last WHERE NOT is_closed AND last - ds < 70) GROUP BY unique_id, k, last
UNION ALL
SELECT f.unique_id, f.cutoff + CAST(7 * f.k + 1 AS INTEGER), 'forecast', f.v,
       f.v * last_value(q.q10 IGNORE NULLS) OVER (PARTITION BY f.unique_id ORDER BY f.k),
       f.v * last_value(q.q90 IGNORE NULLS) OVER (PARTITION BY f.unique_id ORDER BY f.k)
FROM (SELECT unique_id, cutoff, (ds - cutoff - 1) // 7 AS k, sum(forecast) AS v FROM o_future GROUP BY 1, 2, 3) f
JOIN o_profile p ON p.unique_id = f.unique_id
LEFT JOIN o_quantiles q ON q.demand_class = p.demand_class AND q.horizon_week = f.k + 1"""

SQL["kpi_monthly_pivot"] = """
SELECT year_month, coalesce(max(revenue_per_open_day) FILTER (WHERE channel = 'Bán lẻ'), 0) AS retail,
       coalesce(max(revenue_per_open_day) FILTER (WHERE channel = 'Đơn lớn / tổ chức'), 0) AS wholesale
FROM o_monthly GROUP BY year_month"""
SQL["kpi_heat_grid"] = "SELECT iso_weekday, " + ", ".join(
    f"coalesce(max(avg_invoices) FILTER (WHERE sale_hour = {h}), 0) AS h{h}" for h in range(24)
) + " FROM o_heat GROUP BY iso_weekday"
SQL["kpi_least_profitable"] = """
SELECT rank() OVER (ORDER BY profit, cat_l2) AS rank, cat_l2, revenue, profit, margin FROM o_margin QUALIFY rank <= 8"""
SQL["mon_snapshot_list"] = """
SELECT run_id, any_value(kind) AS kind, any_value(week_start) AS week_start, any_value(created_at) AS created_at,
       sum(forecast_week) AS forecast_total FROM o_replay GROUP BY run_id"""



SQL["dq_ambiguous_level3"] = """
SELECT cat_l3, count(*) AS n_parents FROM (SELECT DISTINCT cat_l1, cat_l2, cat_l3 FROM o_daily) GROUP BY cat_l3 HAVING count(*) > 1"""
SQL["kpi_loss_list"] = "SELECT cat_l2, revenue, profit FROM o_margin WHERE quadrant = 'Thua lỗ'"


def contested(names: list[str]) -> dict[str, str]:
    """Statements by query name. Of queries registered twice, SQL repeats the contest among the
    models that work series by series."""
    return {f"{name}_statistical" if name in names else name: sql for name, sql in SQL.items()}


def challenged(names: tuple[str, ...]) -> dict[str, str]:
    """Statements of the third registration, over `oracles.parts.CHALLENGER_PARTS`."""
    return {f"{name}_challenger": SQL[name] for name in names}
