"""Named relations the oracles build on. Names start with o_ so no column clashes."""

from __future__ import annotations

from shelfcast.params import BINDING, INTERNAL_NOTES, ORGANIZATION_NOTES

R = BINDING
_fixes = ", ".join(f"('{bad}', '{good}')" for bad, good in R.category_fixes.items())
_internal = " OR ".join(f"contains(note_text, '{p}')" for p in INTERNAL_NOTES)
_organization = " OR ".join(f"contains(note_text, '{p}')" for p in ORGANIZATION_NOTES)
_holidays = ", ".join(f"({i}, DATE '{h}')" for i, h in enumerate(R.holidays))

PARTS: dict[str, str] = {}

PARTS["o_lineorder"] = """
SELECT li.*, o.o_custkey, o.o_orderstatus, o.o_orderdate,
       p.p_name, p.p_brand, p.p_type, p.p_size, p.p_retailprice,
       (li.l_returnflag = 'R' AND li.l_orderkey % 25 = 0) AS back,
       li.l_orderkey * 7 + li.l_partkey AS ck
FROM lineitem li, orders o, part p
WHERE li.l_orderkey = o.o_orderkey AND li.l_partkey = p.p_partkey
"""

PARTS["o_raw"] = """
SELECT strftime(o_orderdate, '%m-%Y') AS period_month,
       CONCAT(CASE WHEN back THEN 'TH' ELSE 'HD' END, lpad(CAST(l_orderkey AS VARCHAR), 8, '0'),
              CASE WHEN o_orderstatus = 'P' AND l_orderkey % 10 = 0 THEN '.01' ELSE '' END) AS invoice_id,
       'CN1' AS branch,
       CONCAT('clerk', o_custkey % 12, CASE WHEN o_custkey % 12 = 11 THEN '{DEL}' ELSE '' END) AS seller,
       CASE l_orderkey % 60 WHEN 1 THEN 'xuất nội bộ' WHEN 2 THEN 'công ty' WHEN 3 THEN 'khách nợ' END AS note,
       o_orderdate + to_hours(CAST(6 + (l_orderkey * 7) % 16 AS INTEGER)) AS sold_at,
       CONCAT(lpad(CAST(l_partkey AS VARCHAR), 8, '0'),
              CASE WHEN l_partkey % 97 = 0 AND l_orderkey % 2 = 0 THEN '{DEL}' ELSE '' END) AS sku,
       CAST(NULL AS VARCHAR) AS barcode,
       p_name AS product_name,
       CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS brand,
       CASE WHEN l_partkey % 199 = 0 THEN 'Khuyến mại khai chương>>Quà tặng>>Quà tặng'
            WHEN l_partkey % 41 = 0 THEN CONCAT(p_type, '>>', p_type, '-', p_size % 5)
            WHEN p_type = 'SMALL' AND p_size % 5 = 4 AND l_partkey % 6 = 5 THEN 'SMALL{DEL}'
            ELSE CONCAT(p_type, '>>', p_type, '-', p_size % 5, '>>', p_type, '-', p_size % 5, '-', l_partkey % 6)
       END AS category_path,
       CASE WHEN back THEN -l_quantity ELSE l_quantity END AS quantity,
       CASE WHEN (l_orderkey * 3 + l_partkey) % 503 = 0 THEN CAST(0 AS DOUBLE)
            ELSE floor(p_retailprice * (1 - l_discount) * 100 + 0.5) / 100 END AS unit_price,
       CASE WHEN ck % 50 = 0 OR l_partkey % 151 = 0 THEN CAST(0 AS DOUBLE)
            WHEN ck % 251 = 0 THEN p_retailprice * 5
            ELSE floor(p_retailprice * (CAST(0.70 AS DOUBLE) + (l_suppkey % 30) / CAST(100 AS DOUBLE)) * 100 + 0.5) / 100
       END AS unit_cost,
       batch.mark AS source_hash, batch.mark || '.csv' AS source_file, batch.moment AS loaded_at
FROM o_lineorder, (VALUES ('b1', TIMESTAMP '2002-01-01', 1), ('b2', TIMESTAMP '2002-01-02', 200)) batch(mark, moment, every)
WHERE l_orderkey % batch.every = 0
"""

PARTS["o_dedup"] = """
SELECT * EXCLUDE (nth) FROM (
  SELECT *, row_number() OVER (PARTITION BY invoice_id, sold_at, sku
    ORDER BY loaded_at DESC, source_hash DESC, unit_price DESC, quantity DESC, unit_cost DESC) AS nth
  FROM o_raw) WHERE nth = 1
"""

PARTS["o_repaired"] = f"""
SELECT d.* EXCLUDE (category_path),
       replace(coalesce(f.good, trim(d.category_path)), 'Khuyến mại khai chương', 'Khuyến mại khai trương') AS category_path,
       coalesce(lower(trim(d.note)), '') AS note_text
FROM o_dedup d LEFT JOIN (VALUES {_fixes}) f(bad, good) ON f.bad = trim(d.category_path)
"""

PARTS["o_sellers"] = """
SELECT seller, CONCAT('NV', CASE WHEN place < 10 THEN '0' ELSE '' END, place) AS seller_code
FROM (SELECT seller, rank() OVER (ORDER BY n DESC, seller) AS place
      FROM (SELECT seller, count(*) AS n FROM o_repaired GROUP BY seller))
WHERE seller IS NOT NULL
"""

PARTS["o_article_cost"] = """
SELECT sku, quantile_cont(unit_cost, 0.5) AS article_cost FROM o_repaired WHERE unit_cost > 0 GROUP BY sku
"""

PARTS["o_category_share"] = """
SELECT category_path, quantile_cont(unit_cost / unit_price, 0.5) AS cost_share
FROM o_repaired WHERE unit_cost > 0 AND unit_price > 0 GROUP BY category_path
"""

PARTS["o_history"] = """
SELECT invoice_id, sold_at, sku, quantity,
       quantile_cont(CASE WHEN quantity > 0 THEN quantity END, 0.5) OVER (
         PARTITION BY replace(sku, '{DEL}', '') ORDER BY sold_at, invoice_id, sku
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_median_qty
FROM o_repaired
"""

PARTS["o_invoice"] = """
SELECT invoice_id, sum(quantity) AS invoice_qty, sum(quantity * unit_price) AS invoice_value
FROM o_repaired GROUP BY invoice_id
"""

PARTS["o_costed"] = f"""
SELECT r.*, a.article_cost, c.cost_share,
       CASE WHEN r.unit_cost > 0 THEN r.unit_cost
            ELSE coalesce(a.article_cost, r.unit_price * c.cost_share) END AS filled,
       CASE WHEN r.unit_cost > 0 THEN 'actual' WHEN a.article_cost IS NOT NULL THEN 'sku_median'
            WHEN c.cost_share IS NOT NULL THEN 'category_ratio' END AS method
FROM o_repaired r LEFT JOIN o_article_cost a ON a.sku = r.sku
LEFT JOIN o_category_share c ON c.category_path = r.category_path
"""

PARTS["o_channel"] = f"""
SELECT r.invoice_id, r.sold_at, r.sku,
       CASE WHEN {_internal} THEN 'internal'
            WHEN {_organization} THEN 'organization'
            WHEN starts_with(r.invoice_id, 'TH') THEN 'retail'
            WHEN i.invoice_qty >= {R.bulk_invoice_units} OR i.invoice_value >= {R.bulk_invoice_value} THEN 'bulk'
            WHEN r.quantity >= {R.bulk_line_units} AND h.prior_median_qty * {R.bulk_line_ratio} <= r.quantity THEN 'bulk'
            ELSE 'retail' END AS txn_channel
FROM o_repaired r JOIN o_invoice i ON i.invoice_id = r.invoice_id
JOIN o_history h ON h.invoice_id = r.invoice_id AND h.sold_at = r.sold_at AND h.sku = r.sku
"""

PARTS["o_stg"] = f"""
SELECT x.*, quantity * unit_price AS line_revenue,
       CASE WHEN NOT is_cost_suspect THEN quantity * filled END AS line_cogs,
       CASE WHEN NOT is_cost_suspect THEN quantity * (unit_price - filled) END AS line_profit,
       CASE WHEN NOT is_cost_suspect THEN filled END AS unit_cost_filled,
       CASE WHEN NOT is_cost_suspect THEN method END AS cost_fill_method,
       (invoice_type = 'return') AS is_return,
       (unit_price = 0 AND invoice_type = 'sale') AS is_zero_price,
       (cat_l1 = 'Khuyến mại khai trương') AS is_opening_promo,
       (quantity <> trunc(quantity)) AS is_fractional_qty,
       (contains(note_text, 'nợ') OR contains(note_text, 'chưa tt')) AS is_credit_sale
FROM (
  SELECT c.invoice_id, regexp_extract(c.invoice_id, '^[^.]*') AS invoice_base_id,
         CASE WHEN c.invoice_id[1:2] = 'TH' THEN 'return' ELSE 'sale' END AS invoice_type,
         position('.' IN c.invoice_id) > 0 AS is_edited_invoice,
         c.sold_at, CAST(c.sold_at AS DATE) AS sale_date, date_part('hour', c.sold_at) AS sale_hour,
         date_part('isodow', c.sold_at) AS iso_weekday,
         c.branch, s.seller_code, position('{{DEL}}' IN c.seller) = 0 AS seller_active,
         replace(c.sku, '{{DEL}}', '') AS sku, position('{{DEL}}' IN c.sku) > 0 AS sku_deleted, c.barcode,
         trim(c.product_name) AS product_name,
         CASE WHEN coalesce(trim(c.brand), '') = '' THEN 'Không rõ' ELSE trim(c.brand) END AS brand,
         c.category_path, lv[1] AS cat_l1,
         CASE WHEN coalesce(lv[2], '') <> '' THEN lv[2] ELSE lv[1] END AS cat_l2,
         CASE WHEN coalesce(lv[3], '') <> '' THEN lv[3] WHEN coalesce(lv[2], '') <> '' THEN lv[2] ELSE lv[1] END AS cat_l3,
         c.quantity, c.unit_price, c.unit_cost, c.unit_cost = 0 AS cost_missing, c.note, c.note_text,
         c.filled, c.method, ch.txn_channel,
         coalesce(c.unit_price > 0 AND c.filled > {R.suspect_cost_ratio} * c.unit_price, false) AS is_cost_suspect
  FROM (SELECT *, string_split(category_path, '>>') AS lv FROM o_costed) c
  JOIN o_channel ch ON ch.invoice_id = c.invoice_id AND ch.sold_at = c.sold_at AND ch.sku = c.sku
  LEFT JOIN o_sellers s ON s.seller = c.seller
) x
"""

PARTS["o_std"] = """
SELECT *, CAST(date_trunc('month', sale_date) AS DATE) AS month FROM o_stg
WHERE txn_channel = 'retail' AND NOT (is_return OR is_zero_price OR is_opening_promo)
"""

PARTS["o_sold"] = """
SELECT * FROM o_stg WHERE txn_channel = 'retail' AND NOT is_return
"""

PARTS["o_price"] = """
SELECT sku, month, unit_price AS usual_price FROM (
  SELECT sku, month, unit_price, rank() OVER (PARTITION BY sku, month ORDER BY count(*) DESC, unit_price DESC) AS place
  FROM o_std GROUP BY sku, month, unit_price) WHERE place = 1
"""

PARTS["o_cal"] = """
SELECT day AS date, year(day) AS year, month(day) AS month, strftime(day, '%Y-%m') AS year_month,
       isodow(day) AS iso_weekday, isodow(day) > 5 AS is_weekend,
       coalesce(n, 0) AS n_sale_invoices, n IS NOT NULL AS is_open
FROM (SELECT CAST(unnest(range(min(sale_date), max(sale_date) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM o_stg)
LEFT JOIN (SELECT sale_date, count(DISTINCT invoice_id) AS n FROM o_stg WHERE invoice_type = 'sale' GROUP BY sale_date)
  ON sale_date = day
"""

PARTS["o_daily"] = """
SELECT g.date, g.cat_l1, g.cat_l2, g.cat_l3, coalesce(a.quantity, 0) AS quantity, coalesce(a.revenue, 0) AS revenue,
       coalesce(a.profit, 0) AS profit, coalesce(a.n_invoices, 0) AS n_invoices,
       CASE WHEN a.quantity <> 0 THEN coalesce(a.low_qty, 0) / a.quantity END AS promo_qty_share,
       CASE WHEN a.usual_value <> 0 THEN 1 - a.sold_value / a.usual_value END AS discount_depth
FROM (SELECT date, cat_l1, cat_l2, cat_l3 FROM (SELECT DISTINCT cat_l1, cat_l2, cat_l3 FROM o_std),
      (SELECT date FROM o_cal WHERE is_open)) g
LEFT JOIN (
  SELECT s.sale_date, s.cat_l3, sum(s.quantity) AS quantity, sum(s.line_revenue) AS revenue, sum(s.line_profit) AS profit,
         count(DISTINCT s.invoice_id) AS n_invoices,
         sum(CASE WHEN s.unit_price < CAST(0.95 AS DOUBLE) * u.usual_price THEN s.quantity END) AS low_qty,
         sum(s.unit_price * s.quantity) AS sold_value, sum(u.usual_price * s.quantity) AS usual_value
  FROM o_std s JOIN o_price u ON u.sku = s.sku AND u.month = s.month
  GROUP BY s.sale_date, s.cat_l3) a ON a.sale_date = g.date AND a.cat_l3 = g.cat_l3
"""

PARTS["o_traffic"] = """
SELECT sale_date AS date, count(DISTINCT invoice_id) AS n_invoices, sum(line_revenue) AS revenue, sum(quantity) AS quantity
FROM o_sold GROUP BY sale_date
"""

PARTS["o_open"] = "SELECT count(*) AS n FROM o_cal WHERE is_open"

PARTS["o_month_open"] = "SELECT year_month, sum(CAST(is_open AS INTEGER)) AS open_days FROM o_cal GROUP BY year_month"

PARTS["o_monthly"] = """
SELECT m.*, o.open_days, m.revenue / o.open_days AS revenue_per_open_day FROM (
  SELECT strftime(sale_date, '%Y-%m') AS year_month,
         CASE txn_channel WHEN 'retail' THEN 'Bán lẻ' WHEN 'internal' THEN 'Nội bộ' ELSE 'Đơn lớn / tổ chức' END AS channel,
         sum(line_revenue) AS revenue, sum(CASE WHEN cost_fill_method IS NOT NULL THEN line_profit END) AS profit,
         count(DISTINCT CASE WHEN NOT is_return THEN invoice_id END) AS n_invoices, sum(quantity) AS quantity
  FROM o_stg GROUP BY 1, 2) m JOIN o_month_open o ON o.year_month = m.year_month
"""

PARTS["o_abc"] = f"""
SELECT *, CASE WHEN cum_qty_share - quantity / whole < {R.abc_cuts[0]} THEN 'A'
               WHEN cum_qty_share - quantity / whole < {R.abc_cuts[1]} THEN 'B' ELSE 'C' END AS abc_class
FROM (SELECT k.*, sum(quantity) OVER (ORDER BY quantity DESC, sku ROWS UNBOUNDED PRECEDING) / sum(quantity) OVER () AS cum_qty_share,
             rank() OVER (ORDER BY quantity DESC, sku) AS qty_rank, sum(quantity) OVER () AS whole,
             days_sold / CAST(o.n AS DOUBLE) AS sell_day_ratio
      FROM (SELECT sku, max(product_name) AS product_name, max(cat_l1) AS cat_l1, max(cat_l3) AS cat_l3,
                   sum(quantity) AS quantity, sum(line_revenue) AS revenue,
                   sum(CASE WHEN cost_fill_method IS NOT NULL THEN line_profit END) AS profit,
                   count(DISTINCT sale_date) AS days_sold, min(sale_date) AS first_sale, max(sale_date) AS last_sale
            FROM o_sold WHERE NOT is_zero_price GROUP BY sku HAVING sum(quantity) > 0) k, o_open o)
"""

PARTS["o_heat"] = """
SELECT c.iso_weekday, c.sale_hour, c.n / CAST(d.n_days AS DOUBLE) AS avg_invoices, c.revenue / d.n_days AS avg_revenue, d.n_days
FROM (SELECT iso_weekday, sale_hour, count(DISTINCT (invoice_id, sale_date)) AS n, sum(line_revenue) AS revenue
      FROM o_sold GROUP BY iso_weekday, sale_hour) c
JOIN (SELECT iso_weekday, count(*) AS n_days FROM o_cal WHERE is_open GROUP BY iso_weekday) d ON d.iso_weekday = c.iso_weekday
"""


def margin(condition: str) -> str:
    return f"""
SELECT *, CASE WHEN profit < 0 THEN 'Thua lỗ'
     WHEN revenue >= rev_median THEN CASE WHEN margin >= store_margin THEN 'Ngôi sao' ELSE 'Lời mỏng' END
     ELSE CASE WHEN margin >= store_margin THEN 'Tiềm năng' ELSE 'Cần xem xét' END END AS quadrant
FROM (SELECT *, profit / revenue AS margin, revenue / sum(revenue) OVER () AS revenue_share,
             quantile_cont(revenue, 0.5) OVER () AS rev_median, sum(profit) OVER () / sum(revenue) OVER () AS store_margin
      FROM (SELECT cat_l1, cat_l2, sum(line_revenue) AS revenue, sum(line_profit) AS profit,
                   sum(CASE WHEN txn_channel = 'retail' THEN line_profit END)
                     / nullif(sum(CASE WHEN txn_channel = 'retail' THEN line_revenue END), 0) AS retail_margin,
                   sum(CASE WHEN txn_channel = 'retail' THEN line_revenue END) / sum(line_revenue) AS retail_share,
                   count(DISTINCT sku) AS n_sku
            FROM o_stg WHERE txn_channel <> 'internal' AND method IS NOT NULL AND NOT is_cost_suspect
              AND NOT is_opening_promo AND {condition}
            GROUP BY cat_l1, cat_l2 HAVING sum(line_revenue) > 0))
"""


PARTS["o_margin"] = margin("true")

PARTS["o_holidays"] = f"SELECT * FROM (VALUES {_holidays}) h(place, holiday)"

PARTS["o_offset"] = """
SELECT date, arg_min(date_diff('day', holiday, date), abs(date_diff('day', holiday, date)) * 1000 + place) AS off
FROM o_cal, o_holidays GROUP BY date
"""

PARTS["o_holiday_effect"] = f"""
SELECT a.scope AS cat_l1, a.win AS holiday_window, a.n_days, a.q AS qty_per_day, a.r AS rev_per_day,
       a.q / nullif(b.q, 0) AS qty_factor, a.r / nullif(b.r, 0) AS rev_factor
FROM (SELECT scope, win, count(*) AS n_days, avg(q) AS q, avg(r) AS r FROM o_holiday_days GROUP BY scope, win) a
JOIN (SELECT scope, avg(q) AS q, avg(r) AS r FROM o_holiday_days WHERE win = 'Nền' GROUP BY scope) b ON b.scope = a.scope
WHERE a.win <> 'Nền'
"""

PARTS["o_holiday_days"] = f"""
SELECT coalesce(cat_l1, 'Toàn cửa hàng') AS scope, date, sum(quantity) AS q, sum(revenue) AS r,
       max(CASE WHEN off BETWEEN -{R.holiday_before} AND -1 THEN 'Trước Tết'
                WHEN off BETWEEN 0 AND {R.holiday_after} THEN 'Sau Tết' ELSE 'Nền' END) AS win
FROM o_daily JOIN o_offset USING (date) GROUP BY GROUPING SETS ((cat_l1, date), (date))
"""

PARTS["o_purchase"] = """
SELECT invoice_id, sku, min(sale_date) AS sale_date, date_trunc('month', min(sale_date)) AS month,
       sum(quantity) AS qty, sum(line_revenue) AS revenue, quantile_cont(unit_cost_filled, 0.5) AS unit_cost
FROM o_stg WHERE txn_channel IN ('bulk', 'organization') AND NOT is_return AND NOT is_zero_price AND quantity > 0
GROUP BY invoice_id, sku
"""

PARTS["o_bulk"] = """
SELECT p.*, i.product_name, i.cat_l1, i.cat_l3, coalesce(t.retail_qty, 0) AS retail_qty, m.n_data_months,
       p.bulk_qty / (p.bulk_qty + coalesce(t.retail_qty, 0)) AS bulk_share_qty,
       CASE WHEN p.n_bulk_months >= m.n_data_months / CAST(2 AS DOUBLE) THEN 'thuong_xuyen'
            WHEN p.n_bulk_orders > 1 THEN 'thinh_thoang' ELSE 'mot_lan' END AS bulk_frequency,
       CASE WHEN p.n_bulk_months >= m.n_data_months / CAST(2 AS DOUBLE) THEN ceil(p.median_qty_per_order) ELSE 0 END AS reserve_qty,
       CASE WHEN p.n_bulk_months >= m.n_data_months / CAST(2 AS DOUBLE)
            THEN ceil(p.median_qty_per_order) * p.unit_cost ELSE 0 END AS reserve_value
FROM (SELECT sku, count(*) AS n_bulk_orders, count(DISTINCT month) AS n_bulk_months, sum(qty) AS bulk_qty,
             quantile_cont(qty, 0.5) AS median_qty_per_order, max(qty) AS max_qty_per_order, sum(revenue) AS bulk_revenue,
             max(sale_date) AS last_bulk_date, quantile_cont(unit_cost, 0.5) AS unit_cost FROM o_purchase GROUP BY sku) p
JOIN (SELECT DISTINCT ON (sku) sku, product_name, cat_l1, cat_l3 FROM o_stg ORDER BY sku, sold_at DESC, product_name DESC, cat_l1 DESC, cat_l3 DESC) i ON i.sku = p.sku
LEFT JOIN (SELECT sku, sum(quantity) AS retail_qty FROM o_sold WHERE NOT is_zero_price GROUP BY sku) t ON t.sku = p.sku,
(SELECT count(DISTINCT date_trunc('month', sale_date)) AS n_data_months FROM o_stg) m
"""

PARTS["o_bulk_cut"] = f"""
SELECT CAST(date_trunc('month', max(sale_date)) - INTERVAL {R.reserve_test_months - 1} MONTH AS DATE) AS test_start,
       count(DISTINCT date_trunc('month', sale_date)) - {R.reserve_test_months} AS train_months FROM o_stg
"""

PARTS["o_bulk_frequent"] = """
SELECT sku, ceil(quantile_cont(qty, 0.5)) AS reserve_qty, quantile_cont(unit_cost, 0.5) AS unit_cost
FROM o_purchase, o_bulk_cut WHERE sale_date < test_start GROUP BY sku, train_months
HAVING count(DISTINCT month) * 2 >= train_months
"""

PARTS["o_bulk_tested"] = """
SELECT p.sku, p.qty, f.reserve_qty FROM o_purchase p CROSS JOIN o_bulk_cut LEFT JOIN o_bulk_frequent f ON f.sku = p.sku
WHERE p.sale_date >= test_start
"""

PARTS["o_price_days"] = """
SELECT cat_l1, cat_l3, discount_depth AS depth, quantity / avg(quantity) OVER (PARTITION BY cat_l3) AS rel
FROM o_daily WHERE quantity > 0 AND discount_depth IS NOT NULL
"""

PARTS["o_price_response"] = """
SELECT r.*, r.rel_qty_discount / r.rel_qty_normal AS uplift_ratio,
       CASE WHEN r.avg_depth IS NOT NULL THEN greatest(0, (r.rel_qty_discount / r.rel_qty_normal - 1) / r.avg_depth / 100) END AS uplift_per_pct,
       r.discount_days >= 30 AS reliable,
       greatest(0, (s.hi / s.lo - 1) / s.depth / 100) AS store_uplift_per_pct
FROM (SELECT cat_l1, count(*) FILTER (WHERE depth > 0.05) AS discount_days, avg(depth) FILTER (WHERE depth > 0.05) AS avg_depth,
             avg(rel) FILTER (WHERE depth > 0.05) AS rel_qty_discount, avg(rel) FILTER (WHERE depth <= 0.05) AS rel_qty_normal
      FROM o_price_days GROUP BY cat_l1) r,
     (SELECT avg(rel) FILTER (WHERE depth > 0.05) AS hi, avg(rel) FILTER (WHERE depth <= 0.05) AS lo,
             avg(depth) FILTER (WHERE depth > 0.05) AS depth FROM o_price_days) s
"""

PARTS["o_basket"] = f"""
SELECT invoice_id, item FROM (SELECT *, count(*) OVER (PARTITION BY invoice_id) AS size FROM (
  SELECT DISTINCT s.invoice_id, s.{R.basket_level} AS item FROM o_std s JOIN o_price u ON u.sku = s.sku AND u.month = s.month
  WHERE s.unit_price >= CAST({R.discount_cut} AS DOUBLE) * u.usual_price)) WHERE size > 1
"""

PARTS["o_basket_item"] = "SELECT item, count(*) AS n FROM o_basket GROUP BY item"

PARTS["o_open_place"] = "SELECT date, row_number() OVER (ORDER BY date) AS place FROM o_cal WHERE is_open"

def _entity_days(entity: str, ratio: float) -> str:
    return f"""
SELECT DISTINCT s.{entity} AS entity, d.place
FROM o_sold s JOIN o_open_place d ON d.date = s.sale_date
WHERE s.{entity} IN (
  SELECT {entity} FROM o_sold WHERE NOT is_zero_price GROUP BY 1
  HAVING sum(quantity) > 0 AND count(DISTINCT sale_date) >= CAST({ratio} AS DOUBLE) * (SELECT n FROM o_open))
"""


PARTS["o_entity_days"] = _entity_days(R.stockout_entity, R.min_sell_ratio)
PARTS["o_article_days"] = _entity_days("sku", 0.01)
PARTS["o_article_names"] = "SELECT sku AS entity, max(product_name) AS product_name, max(cat_l3) AS cat_l3 FROM o_sold GROUP BY sku"

PARTS["o_traffic_month"] = """
SELECT strftime(date, '%Y-%m') AS year_month, sum(n_invoices) / CAST(count(*) AS DOUBLE) AS inv_per_day,
       sum(revenue) / sum(n_invoices) AS basket FROM o_traffic GROUP BY 1
"""

# --- series ------------------------------------------------------------------------------

L = R.series_level

PARTS["o_series"] = f"""
SELECT c.unique_id, d.date AS ds, s.y_raw, NOT d.is_open AS is_closed,
       d.off BETWEEN -{R.holiday_before} AND {R.holiday_after} AS in_holiday_window, c.cat_l1, c.cat_l2
FROM (SELECT {L} AS unique_id, min(cat_l1) AS cat_l1, min(cat_l2) AS cat_l2 FROM o_daily GROUP BY 1) c
CROSS JOIN (SELECT date, is_open, off FROM o_cal JOIN o_offset USING (date)) d
LEFT JOIN (SELECT {L} AS unique_id, date, sum(quantity) AS y_raw FROM o_daily GROUP BY 1, 2) s
  ON s.unique_id = c.unique_id AND s.date = d.date
"""

PARTS["o_imputed"] = f"""
SELECT * EXCLUDE (clean, before, after),
       CASE WHEN NOT is_imputed THEN y_raw WHEN before IS NOT NULL THEN before WHEN after IS NOT NULL THEN after ELSE 0 END AS y
FROM (SELECT *, quantile_cont(clean, 0.5) OVER (w ROWS BETWEEN {R.impute_weeks} PRECEDING AND 1 PRECEDING) AS before,
             quantile_cont(clean, 0.5) OVER (w ROWS BETWEEN 1 FOLLOWING AND {R.impute_weeks} FOLLOWING) AS after
      FROM (SELECT *, is_closed OR in_holiday_window AS is_imputed,
                   CASE WHEN NOT (is_closed OR in_holiday_window) THEN y_raw END AS clean FROM o_series)
      WINDOW w AS (PARTITION BY unique_id, isodow(ds) ORDER BY ds))
"""


def classes(condition: str) -> str:
    return f"""
SELECT *, CASE WHEN sale_days < {R.min_sale_days} THEN 'insufficient'
     WHEN adi < {R.adi_cut} THEN CASE WHEN cv2 < {R.cv2_cut} THEN 'smooth' ELSE 'erratic' END
     WHEN cv2 < {R.cv2_cut} THEN 'intermittent' ELSE 'lumpy' END AS demand_class
FROM (SELECT unique_id, min(cat_l1) AS cat_l1, min(cat_l2) AS cat_l2, count(*) FILTER (WHERE y_raw > 0) AS sale_days,
             count(*) AS open_days, count(*) / CAST(nullif(count(*) FILTER (WHERE y_raw > 0), 0) AS DOUBLE) AS adi,
             pow(stddev_samp(y_raw) FILTER (WHERE y_raw > 0) / avg(y_raw) FILTER (WHERE y_raw > 0), 2) AS cv2,
             sum(y_raw) AS total_qty, avg(y_raw) AS mean_daily_qty
      FROM o_imputed WHERE NOT is_closed AND {condition} GROUP BY unique_id)
"""


PARTS["o_last"] = "SELECT max(date) AS last FROM o_cal"
PARTS["o_profile"] = classes("true")
PARTS["o_profile_before"] = classes(
    f"ds <= (SELECT last - {R.horizon * R.n_windows} FROM o_last)")
PARTS["o_cut"] = f"""
SELECT last - CAST({R.horizon} * (1 + k) AS INTEGER) AS cutoff FROM o_last, range({R.n_windows}) r(k)
"""
PARTS["o_cut_long"] = f"""
SELECT last - CAST({R.long_horizon} + {R.horizon} * k AS INTEGER) AS cutoff FROM o_last, range({R.long_windows}) r(k)
"""
PARTS["o_cut_now"] = "SELECT last AS cutoff FROM o_last"
PARTS["o_known"] = """
SELECT * FROM o_imputed WHERE unique_id IN (SELECT unique_id FROM o_profile_before WHERE demand_class <> 'insufficient')
"""
PARTS["o_known_now"] = """
SELECT * FROM o_imputed WHERE unique_id IN (SELECT unique_id FROM o_profile WHERE demand_class <> 'insufficient')
"""


def history(cuts: str, known: str) -> str:
    return f"""
SELECT unique_id, cutoff, list(y ORDER BY ds) AS ys, avg(y) AS mean_all, avg(y) FILTER (WHERE ds > cutoff - 28) AS mean_28
FROM {known}, {cuts} WHERE ds <= cutoff GROUP BY unique_id, cutoff
"""


_LEVEL = "list_reduce({x}, lambda a, v: CAST(0.2 AS DOUBLE) * v + CAST(0.8 AS DOUBLE) * a)"
_DEMAND = "list_filter(ys, lambda v: v > 0)"


def native(hist: str, horizon: int) -> str:
    chance = _LEVEL.format(x="list_transform(ys, lambda v: CASE WHEN v <> 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")
    size = _LEVEL.format(x=_DEMAND)
    return f"""
SELECT unique_id, cutoff, cutoff + CAST(step AS INTEGER) AS ds, m.model, greatest(m.yhat, 0) AS yhat
FROM (SELECT *, {chance} * {size} AS tsb FROM {hist}), range(1, {horizon + 1}) r(step),
LATERAL (SELECT unnest([
  {{'model': 'HistoricAverage', 'yhat': mean_all}}, {{'model': 'MovingAvg28', 'yhat': mean_28}},
  {{'model': 'SeasonalNaive', 'yhat': ys[len(ys) - 6 + CAST((step - 1) % 7 AS INTEGER)]}},
  {{'model': 'TSB', 'yhat': tsb}}], recursive := true)) m
"""


PARTS["o_hist"] = history("o_cut", "o_known")
PARTS["o_hist_long"] = history("o_cut_long", "o_known")
PARTS["o_hist_now"] = history("o_cut_now", "o_known_now")
PARTS["o_native"] = native("o_hist", R.horizon)
PARTS["o_native_long"] = native("o_hist_long", R.long_horizon)
PARTS["o_native_now"] = native("o_hist_now", R.long_horizon)


def best_level(x: str) -> str:
    """Best of the eleven weights by squared one-step error, for a list column."""
    return f"""list_min(list_transform(range(11), lambda k: list_reduce(
      list_transform({x}, lambda v: {{'sse': CAST(0 AS DOUBLE), 'level': v}}),
      lambda s, e: {{'sse': s.sse + (e.level - s.level) * (e.level - s.level),
                     'level': (CAST(0.1 AS DOUBLE) + CAST(0.02 AS DOUBLE) * k) * e.level
                              + (CAST(1 AS DOUBLE) - (CAST(0.1 AS DOUBLE) + CAST(0.02 AS DOUBLE) * k)) * s.level}}))).level"""


def gaps(hist: str) -> str:
    return f"""
SELECT unique_id, cutoff, ys, {_DEMAND} AS sizes, places,
       list_transform(places, lambda p, i: CAST(p - CASE WHEN i = 1 THEN 0 ELSE places[i - 1] END AS DOUBLE)) AS gaps,
       CAST(round_even(places[len(places)] / CAST(len(places) AS DOUBLE), 0) AS INTEGER) AS mean_gap
FROM (SELECT *, list_filter(list_transform(ys, lambda v, i: CASE WHEN v > 0 THEN i END), lambda p: p IS NOT NULL) AS places FROM {hist})
"""


def blocks(gap_part: str) -> str:
    return f"""
SELECT unique_id, cutoff, k, longest, {best_level('sums')} / k AS rate
FROM (SELECT unique_id, cutoff, longest, k,
             list_transform(range(len(ys) // k), lambda b: list_sum(ys[len(ys) % k + b * k + 1 : len(ys) % k + b * k + k])) AS sums
      FROM (SELECT *, coalesce(mean_gap, 1) AS longest, unnest(range(1, coalesce(mean_gap, 1) + 1)) AS k FROM {gap_part}))
"""


# Exponential smoothing: one row per series, variant and day, day after day.
_grid = [(a, b, g) for a in (0.02, 0.05, 0.1, 0.2, 0.4) for b in (0.0, 0.02) for g in (0.0, 0.02, 0.1)]
PARTS["o_variants"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({g} AS DOUBLE))" for i, (a, b, g) in enumerate(_grid)) + ") v(variant, alpha, beta, gamma)"
# Weeks end on a series' last day, as the cutoffs do; days before its first are null.
PARTS["o_ets_days"] = """
SELECT unique_id, ds, y, t, (t + shift) // 7 AS w, (t + shift) % 7 AS j, shift
FROM (SELECT *, (7 - count(*) OVER (PARTITION BY unique_id) % 7) % 7 AS shift
      FROM (SELECT unique_id, ds, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS t FROM o_imputed))
"""
PARTS["o_ets_weeks"] = "SELECT unique_id, w, max(ds) AS ds, count(*) AS days, " + ", ".join(
    f"max(y) FILTER (WHERE j = {j}) AS y{j}" for j in range(7)) + " FROM o_ets_days GROUP BY unique_id, w"
PARTS["o_ets_start"] = """
SELECT unique_id, shift, list_sum(f) / len(f) AS start,
       list_transform(range(7), lambda i: CASE WHEN i >= len(f) THEN list_sum(f) / len(f) WHEN i + 7 >= len(f) THEN f[i + 1]
                      ELSE (f[i + 1] + f[i + 8]) / CAST(2 AS DOUBLE) END - list_sum(f) / len(f)) AS pattern
FROM (SELECT unique_id, any_value(shift) AS shift, list(y ORDER BY ds) AS f FROM o_ets_days WHERE t < 14 GROUP BY unique_id)
"""


def _week() -> str:
    """One week of smoothing, a nested select per day."""
    sql = "SELECT run.*, w.ds AS day, w.days, " + ", ".join(f"w.y{j}" for j in range(7)) + (
        " FROM run JOIN o_ets_weeks w ON w.unique_id = run.unique_id AND w.w = run.weeks")
    for j in range(7):
        sql = f"SELECT *, coalesce(y{j} - (level + slope + s{j}), 0) AS e, y{j} IS NOT NULL AS known FROM ({sql})"
        sql = (f"SELECT * EXCLUDE (e, known) REPLACE (sse + e * e AS sse, CASE WHEN known THEN level + slope + alpha * e ELSE level END AS level, "
               f"slope + beta * alpha * e AS slope, s{j} + gamma * e AS s{j}) FROM ({sql})")
    return sql


PARTS["o_ets_states"] = f"""
WITH RECURSIVE run AS (
  SELECT s.unique_id, v.*, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS weeks, CAST(NULL AS DATE) AS ds, CAST(0 AS DOUBLE) AS sse,
         s.start AS level, CAST(0 AS DOUBLE) AS slope,
         {", ".join(f"CASE WHEN gamma > 0 THEN s.pattern[({j} + 7 - shift) % 7 + 1] ELSE CAST(0 AS DOUBLE) END AS s{j}" for j in range(7))}
  FROM o_ets_start s, o_variants v
  UNION ALL
  SELECT unique_id, variant, alpha, beta, gamma, n + days, weeks + 1, day, sse, level, slope, {", ".join(f"s{j}" for j in range(7))} FROM ({_week()}))
SELECT * FROM run WHERE ds IN (SELECT cutoff FROM o_cut UNION SELECT cutoff FROM o_cut_long UNION SELECT cutoff FROM o_cut_now)
"""
PARTS["o_ets_best"] = f"""
SELECT unique_id, ds AS cutoff, level, slope, [{", ".join(f"s{j}" for j in range(7))}] AS season FROM (
  SELECT *, n * ln(greatest(sse, 1e-9) / n) + 2 * k + 2 * k * (k + 1) / CAST(greatest(n - k - 1, 1) AS DOUBLE) AS criterion
  FROM (SELECT *, 2 + 2 * CASE WHEN beta > 0 THEN 1 ELSE 0 END + 7 * CASE WHEN gamma > 0 THEN 1 ELSE 0 END AS k FROM o_ets_states))
QUALIFY row_number() OVER (PARTITION BY unique_id, ds ORDER BY round(criterion, 6), variant) = 1
"""


def statistical(hist: str, native_part: str, gap_part: str, block_part: str, horizon: int) -> str:
    """The eight models that work series by series, by day ahead."""
    ahead = f"range(1, {horizon + 1}) r(step)"
    day = "cutoff + CAST(step AS INTEGER) AS ds"
    return f"""
SELECT * FROM {native_part}
UNION ALL SELECT unique_id, cutoff, {day}, 'Croston', coalesce({best_level('sizes')} / {best_level('gaps')}, 0) FROM {gap_part}, {ahead}
UNION ALL SELECT unique_id, cutoff, {day}, 'ADIDA', rate FROM {block_part}, {ahead} WHERE k = longest
UNION ALL SELECT unique_id, cutoff, {day}, 'IMAPA', rate FROM (SELECT unique_id, cutoff, avg(rate) AS rate FROM {block_part} GROUP BY 1, 2), {ahead}
UNION ALL SELECT b.unique_id, b.cutoff, b.{day}, 'AutoETS', greatest(level + slope * step + season[(step - 1) % 7 + 1], 0)
FROM o_ets_best b JOIN {hist} h ON h.unique_id = b.unique_id AND h.cutoff = b.cutoff, {ahead}
"""


for _suffix, _horizon in (("", R.horizon), ("_long", R.long_horizon), ("_now", R.long_horizon)):
    PARTS["o_gaps" + _suffix] = gaps("o_hist" + _suffix)
    PARTS["o_blocks" + _suffix] = blocks("o_gaps" + _suffix)
    PARTS["o_stat" + _suffix] = statistical(
        "o_hist" + _suffix, "o_native" + _suffix, "o_gaps" + _suffix, "o_blocks" + _suffix, _horizon)

# --- scoring ---------------------------------------------------------------------------------

PARTS["o_errors"] = """
SELECT f.*, a.y_raw FROM o_stat f JOIN o_imputed a ON a.unique_id = f.unique_id AND a.ds = f.ds WHERE NOT a.is_closed
"""
PARTS["o_weeks"] = f"""
SELECT w.*, CASE WHEN w.win <= {R.n_selection} THEN 'selection' ELSE 'holdout' END AS phase, p.demand_class, p.cat_l1, p.cat_l2
FROM (SELECT unique_id, cutoff, model, sum(y_raw) AS y, sum(yhat) AS yhat, dense_rank() OVER (ORDER BY cutoff) AS win
      FROM o_errors GROUP BY unique_id, cutoff, model) w JOIN o_profile_before p ON p.unique_id = w.unique_id
"""
PARTS["o_hold"] = "SELECT * FROM o_weeks WHERE phase = 'holdout'"
_measures = """avg(abs(yhat - y)) AS "MAE", sum(abs(yhat - y)) / nullif(sum(abs(y)), 0) AS "WMAPE",
       sum(yhat - y) / nullif(sum(abs(y)), 0) AS "Bias", quantile_cont(CASE WHEN y > 0 THEN abs(yhat - y) / y END, 0.5) AS "MdAPE" """
PARTS["o_metrics"] = f"""
SELECT 'Tổng thể' AS scope, model, {_measures} FROM o_hold GROUP BY model
UNION ALL SELECT demand_class, model, {_measures} FROM o_hold GROUP BY demand_class, model
UNION ALL SELECT 'Giai đoạn chọn mô hình', model, {_measures} FROM o_weeks WHERE phase = 'selection' GROUP BY model
"""
PARTS["o_champion"] = f"""
SELECT model, "WMAPE" AS wmape, "Bias" AS bias FROM o_metrics WHERE scope = 'Giai đoạn chọn mô hình'
ORDER BY CASE WHEN abs("Bias") <= {R.max_abs_bias} THEN 0 ELSE 1 END, "WMAPE",
         list_position(['HistoricAverage', 'MovingAvg28', 'SeasonalNaive', 'AutoETS', 'Croston', 'ADIDA', 'IMAPA', 'TSB'], model) LIMIT 1
"""
_level = """SELECT '{name}' AS level, model, sum(abs(f - y)) / nullif(sum(abs(y)), 0) AS "WMAPE", sum(f - y) / sum(y) AS "Bias"
FROM (SELECT model, sum(yhat) AS f, sum(y) AS y FROM o_hold GROUP BY model, cutoff{key}) GROUP BY model"""
PARTS["o_levels"] = " UNION ALL ".join(_level.format(name=n, key=k) for n, k in (
    ("Nhóm hàng cấp 3", ", unique_id"), ("Nhóm hàng cấp 2", ", cat_l2"), ("Ngành hàng cấp 1", ", cat_l1"),
    ("Toàn cửa hàng", "")))
PARTS["o_report"] = """
SELECT h.*, b.wmape_baseline, coalesce(round(h.wmape, 9) < round(b.wmape_baseline, 9), false) AS improved,
       CASE WHEN demand_class = 'insufficient' OR wmape IS NULL THEN 'Chưa đủ dữ liệu' WHEN wmape <= 0.30 THEN 'Cao'
            WHEN wmape <= 0.50 THEN 'Trung bình' ELSE 'Thấp' END AS confidence
FROM (SELECT unique_id, any_value(demand_class) AS demand_class, any_value(cat_l1) AS cat_l1, any_value(cat_l2) AS cat_l2,
             sum(abs(yhat - y)) / nullif(sum(y), 0) AS wmape, sum(yhat - y) / greatest(sum(y), 1e-9) AS bias,
             CASE WHEN avg(abs(yhat - y)) = 0 THEN 0 ELSE sum(yhat - y) / avg(abs(yhat - y)) END AS tracking_signal,
             sum(y) AS holdout_qty
      FROM o_hold WHERE model = (SELECT model FROM o_champion) GROUP BY unique_id) h
JOIN (SELECT unique_id, sum(abs(yhat - y)) / nullif(sum(y), 0) AS wmape_baseline FROM o_hold
      WHERE model = 'HistoricAverage' GROUP BY unique_id) b ON b.unique_id = h.unique_id
"""
PARTS["o_loss_days"] = """
SELECT o.model AS compared_to, o.ds, avg(abs(c.yhat - c.y_raw) - abs(o.yhat - o.y_raw)) AS d
FROM o_errors c JOIN o_errors o ON o.unique_id = c.unique_id AND o.ds = c.ds AND o.model <> c.model
WHERE c.model = (SELECT model FROM o_champion) AND c.cutoff IN (SELECT cutoff FROM o_hold) GROUP BY o.model, o.ds
"""
PARTS["o_loss_centred"] = """
SELECT *, d - avg(d) OVER (PARTITION BY compared_to) AS c, row_number() OVER (PARTITION BY compared_to ORDER BY ds) AS t FROM o_loss_days
"""
PARTS["o_gamma"] = f"""
SELECT a.compared_to, a.t - b.t AS k, sum(a.c * b.c) AS g FROM o_loss_centred a JOIN o_loss_centred b
  ON b.compared_to = a.compared_to AND a.t - b.t BETWEEN 0 AND {R.horizon - 1} GROUP BY 1, 2
"""
PARTS["o_loss_series"] = """
SELECT * FROM (
  SELECT o.model AS compared_to, o.unique_id, avg(abs(c.yhat - c.y) - abs(o.yhat - o.y)) AS d
  FROM o_hold c JOIN o_hold o ON o.unique_id = c.unique_id AND o.cutoff = c.cutoff AND o.model <> c.model
  WHERE c.model = (SELECT model FROM o_champion) GROUP BY 1, 2) WHERE d <> 0
"""
PARTS["o_signed"] = """
SELECT *, rank() OVER (PARTITION BY compared_to ORDER BY size) + (count(*) OVER (PARTITION BY compared_to, size) - 1) / CAST(2 AS DOUBLE) AS r,
       count(*) OVER (PARTITION BY compared_to, size) AS ties
FROM (SELECT *, round(abs(d), 9) AS size FROM o_loss_series)
"""

# --- orders ---------------------------------------------------------------------------------------

_names = ["q10", "q50", "q55", "q70", "q80", "q90"]
_picks = ", ".join(f"q[{i + 1}] AS {n}" for i, n in enumerate(_names))


def ratios(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, {_picks}, n_weeks FROM (
  SELECT {keys}, quantile_cont(y / yhat, [0.1, 0.5, 0.55, 0.7, 0.8, 0.9]) AS q, count(*) AS n_weeks
  FROM {source} WHERE yhat > {R.min_forecast_for_ratio} GROUP BY {keys})
"""


PARTS["o_champion_weeks"] = "SELECT * FROM o_weeks WHERE model = (SELECT model FROM o_champion)"
PARTS["o_selection_weeks"] = "SELECT * FROM o_champion_weeks WHERE phase = 'selection'"
PARTS["o_ratio"] = ratios("o_champion_weeks", "demand_class")
PARTS["o_ratio_selection"] = ratios("o_selection_weeks", "demand_class")
PARTS["o_long_weeks"] = """
SELECT f.unique_id, f.cutoff, (f.ds - f.cutoff - 1) // 7 + 1 AS horizon_week, p.demand_class, sum(a.y_raw) AS y, sum(f.yhat) AS yhat
FROM o_stat_long f JOIN o_imputed a ON a.unique_id = f.unique_id AND a.ds = f.ds
JOIN o_profile_before p ON p.unique_id = f.unique_id
WHERE NOT a.is_closed AND f.model = (SELECT model FROM o_champion) GROUP BY 1, 2, 3, 4
"""
PARTS["o_ratio_long"] = ratios("o_long_weeks", "demand_class, horizon_week")
PARTS["o_quantiles"] = """
SELECT *, 1 AS horizon_week FROM o_ratio UNION ALL BY NAME SELECT * FROM o_ratio_long
WHERE horizon_week > 1 AND (SELECT model FROM o_champion) IN ('AutoETS', 'IMAPA')
"""
_lives = ", ".join(f"('{n}', {w})" for n, w in R.shelf_life.items())
PARTS["o_lives"] = f"SELECT * FROM (VALUES {_lives}) v(name, life)"


def service(profile: str, margin_part: str) -> str:
    return f"""
SELECT *, CASE service_class WHEN 'Ngôi sao' THEN 0.80 WHEN 'Dễ hư hỏng' THEN 0.55 ELSE 0.70 END AS tau
FROM (SELECT p.*, m.quadrant, CASE WHEN v.life <= {R.perishable_max_weeks} THEN 'Dễ hư hỏng'
             WHEN m.quadrant = 'Ngôi sao' THEN 'Ngôi sao' ELSE 'Bảo quản lâu' END AS service_class
      FROM {profile} p LEFT JOIN (SELECT cat_l2, max(quadrant) AS quadrant FROM {margin_part} GROUP BY cat_l2) m ON m.cat_l2 = p.cat_l2
      LEFT JOIN o_lives v ON v.name = p.unique_id)
"""


_factor = "CASE tau WHEN 0.80 THEN q80 WHEN 0.55 THEN q55 WHEN 0.70 THEN q70 END"
PARTS["o_service"] = service("o_profile", "o_margin")
PARTS["o_start"] = f"SELECT last - {R.horizon * (R.n_windows - R.n_selection)} AS cut FROM o_last"
PARTS["o_margin_before"] = margin("method = 'actual' AND sale_date <= (SELECT cut FROM o_start)")
PARTS["o_service_before"] = service("o_profile_before", "o_margin_before")
PARTS["o_factors"] = "SELECT cat_l1, holiday_window, qty_factor FROM o_holiday_effect WHERE cat_l1 <> 'Toàn cửa hàng'"
PARTS["o_offset_all"] = """
SELECT day, arg_min(date_diff('day', holiday, day), abs(date_diff('day', holiday, day)) * 1000 + place) AS off
FROM (SELECT CAST(unnest(generate_series(min(date), max(date) + 60, INTERVAL 1 DAY)) AS DATE) AS day FROM o_cal), o_holidays GROUP BY day
"""


def layered(source: str) -> str:
    return f"""
SELECT f.*, p.cat_l1, h.w AS holiday_window, coalesce(x.qty_factor, 1) AS holiday_factor, f.yhat * coalesce(x.qty_factor, 1) AS forecast
FROM {source} f JOIN o_profile p ON p.unique_id = f.unique_id
JOIN (SELECT day, CASE WHEN off BETWEEN -{R.holiday_before} AND -1 THEN 'Trước Tết' WHEN off BETWEEN 0 AND {R.holiday_after} THEN 'Sau Tết' ELSE '' END AS w
      FROM o_offset_all) h ON h.day = f.ds
LEFT JOIN o_factors x ON x.cat_l1 = p.cat_l1 AND x.holiday_window = h.w
"""


PARTS["o_future"] = layered("(SELECT * FROM o_stat_now WHERE model = (SELECT model FROM o_champion))")
PARTS["o_unit"] = f"""
SELECT {L} AS unique_id, sum(quantity * unit_cost_filled) / sum(quantity) AS unit_cost FROM o_stg
WHERE txn_channel = 'retail' AND quantity > 0 AND cost_fill_method IS NOT NULL GROUP BY 1
"""
PARTS["o_unit_before"] = f"""
SELECT {L} AS unique_id, sum(quantity * unit_cost) / sum(quantity) AS unit_cost, sum(line_revenue) / sum(quantity) AS unit_price FROM o_stg
WHERE txn_channel = 'retail' AND quantity > 0 AND NOT is_zero_price AND cost_fill_method = 'actual'
  AND sale_date <= (SELECT cut FROM o_start) GROUP BY 1
"""
PARTS["o_plan"] = f"""
SELECT *, order_qty * unit_cost AS order_value FROM (
  SELECT w.*, s.cat_l1, s.cat_l2, s.demand_class, s.service_class, s.tau, s.quadrant, r.wmape,
         CASE WHEN s.demand_class = 'insufficient' OR r.wmape IS NULL THEN 'Chưa đủ dữ liệu' WHEN r.wmape <= 0.30 THEN 'Cao'
              WHEN r.wmape <= 0.50 THEN 'Trung bình' ELSE 'Thấp' END AS confidence,
         w.forecast_week * q.q10 AS lower_80, w.forecast_week * q.q90 AS upper_80,
         ceil(round(w.forecast_week * coalesce({_factor}, 1), 6)) AS order_qty, u.unit_cost
  FROM (SELECT unique_id, sum(forecast) AS forecast_week, min(ds) AS week_start FROM o_future WHERE ds - cutoff <= 7 GROUP BY 1) w
  JOIN o_service s ON s.unique_id = w.unique_id LEFT JOIN o_report r ON r.unique_id = w.unique_id
  LEFT JOIN o_ratio q ON q.demand_class = s.demand_class LEFT JOIN o_unit u ON u.unique_id = w.unique_id)
"""
PARTS["o_top"] = f"""
SELECT * FROM (SELECT *, rank() OVER (PARTITION BY cat ORDER BY qty DESC, sku) AS rk FROM (
  SELECT {L} AS cat, sku, max(product_name) AS product_name, sum(quantity) AS qty FROM o_sold, o_last
  WHERE NOT is_zero_price AND last - sale_date < {R.share_days} GROUP BY 1, 2)) WHERE rk <= {R.top_skus}
"""
PARTS["o_policy"] = f"""
SELECT w.unique_id, w.cutoff, w.y, m.policy, ceil(round(m.wanted, 6)) AS wanted,
       coalesce(u.unit_cost, (SELECT quantile_cont(unit_cost, 0.5) FROM o_unit_before)) AS cost,
       coalesce(u.unit_price, (SELECT quantile_cont(unit_price, 0.5) FROM o_unit_before)) AS price,
       (SELECT life FROM o_lives WHERE name = w.unique_id) AS life,
       row_number() OVER (PARTITION BY w.unique_id, m.policy ORDER BY w.cutoff) AS n
FROM (SELECT h.unique_id, h.cutoff, any_value(h.y) AS y, any_value(s.tau) AS tau, any_value(h.demand_class) AS demand_class,
             max(CASE WHEN model = 'HistoricAverage' THEN yhat END) AS a, max(CASE WHEN model = 'MovingAvg28' THEN yhat END) AS b,
             max(CASE WHEN model = (SELECT model FROM o_champion) THEN yhat END) AS c
      FROM o_hold h JOIN o_service_before s ON s.unique_id = h.unique_id GROUP BY 1, 2) w
LEFT JOIN o_ratio_selection q ON q.demand_class = w.demand_class LEFT JOIN o_unit_before u ON u.unique_id = w.unique_id,
LATERAL (SELECT unnest([{{'policy': 'baseline', 'wanted': a}}, {{'policy': 'moving_average', 'wanted': b}}, {{'policy': 'point', 'wanted': c}},
  {{'policy': 'quantile', 'wanted': c * coalesce({_factor}, 1)}}], recursive := true)) m
"""
PARTS["o_single"] = """
SELECT 'Một kỳ (không chuyển tồn)' AS mode, policy, sum(wanted) AS units_ordered, sum(greatest(y - wanted, 0)) AS units_short,
       sum(greatest(wanted - y, 0)) AS units_excess,
       count(*) FILTER (WHERE y > 0 AND y - wanted <= 0.5) / CAST(count(*) FILTER (WHERE y > 0) AS DOUBLE) AS service_level,
       1 - sum(greatest(y - wanted, 0)) / sum(y) AS fill_rate, sum(greatest(wanted - y, 0) * cost) AS excess_value
FROM o_policy GROUP BY policy
"""
PARTS["o_replay"] = """
SELECT 'backtest-' || strftime(cutoff, '%Y%m%d') AS run_id, 'Mô phỏng lại' AS kind, cutoff AS created_at, cutoff AS data_until,
       cutoff + 1 AS week_start, model, unique_id, yhat AS forecast_week, CAST(NULL AS DOUBLE) AS order_qty
FROM o_hold WHERE model = (SELECT model FROM o_champion)
"""
PARTS["o_runs"] = """
SELECT run_id, any_value(kind) AS kind, any_value(week_start) AS week_start, any_value(model) AS model,
       sum(abs(actual - forecast_week)) / nullif(sum(actual), 0) AS wmape, sum(forecast_week - actual) / nullif(sum(actual), 0) AS bias,
       sum(actual) AS actual_total, sum(forecast_week) AS forecast_total, count(*) AS n_series
FROM (SELECT s.run_id, s.kind, s.week_start, s.model, s.unique_id, s.forecast_week, sum(a.y_raw) AS actual
      FROM o_replay s JOIN o_imputed a ON a.unique_id = s.unique_id AND a.ds - s.week_start BETWEEN 0 AND 6
      WHERE NOT a.is_closed AND s.week_start + 6 <= (SELECT last FROM o_last) GROUP BY ALL) GROUP BY run_id
"""
PARTS["o_drift"] = f"""
SELECT *, over_limit OR biased AS flagged FROM (
  SELECT *, abs(tracking_signal) > {R.ts_limit} AS biased,
         wmape > {R.drift_factor} * (SELECT "WMAPE" FROM o_metrics WHERE scope = 'Tổng thể' AND model = (SELECT model FROM o_champion)) AS over_limit
  FROM (SELECT *, CASE WHEN avg(abs(forecast_total - actual_total)) OVER w = 0 THEN 0 ELSE
               sum(forecast_total - actual_total) OVER w / avg(abs(forecast_total - actual_total)) OVER w END AS tracking_signal,
               week_start = max(week_start) OVER () AS is_latest
        FROM o_runs WINDOW w AS (ORDER BY week_start ROWS UNBOUNDED PRECEDING)))
"""

_SUM = "coalesce(list_sum(list_transform({x}, lambda l: l.qty)), 0)"
PARTS["o_stock"] = f"""
WITH RECURSIVE sim AS (
  SELECT DISTINCT policy, unique_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(qty DOUBLE, age INTEGER)[]) AS lots,
         CAST(0 AS DOUBLE) AS bought, CAST(0 AS DOUBLE) AS miss, CAST(0 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS expired,
         CAST(0 AS DOUBLE) AS cost, CAST(0 AS DOUBLE) AS price
  FROM o_policy
  UNION ALL
  SELECT policy, unique_id, n, list_filter(aged, lambda l: life IS NULL OR l.age < life), bought, y - sold, y,
         {_SUM.format(x="list_filter(aged, lambda l: coalesce(l.age >= life, false))")}, cost, price
  FROM (SELECT *, list_filter(list_transform(pool, lambda l, i: {{
                 'qty': l.qty - least(l.qty, greatest(sold - {_SUM.format(x="pool[1:i - 1]")}, 0)), 'age': l.age + 1}}),
                 lambda l: l.qty > 1e-9) AS aged
        FROM (SELECT *, least(y, on_hand + bought) AS sold,
                     CASE WHEN bought > 0 THEN list_append(lots, {{'qty': bought, 'age': CAST(0 AS INTEGER)}}) ELSE lots END AS pool
              FROM (SELECT *, greatest(wanted - on_hand, 0) AS bought
                    FROM (SELECT s.policy, s.unique_id, w.n, s.lots, w.y, w.wanted, w.cost, w.price, w.life,
                                 {_SUM.format(x="s.lots")} AS on_hand
                          FROM sim s JOIN o_policy w ON w.policy = s.policy AND w.unique_id = s.unique_id AND w.n = s.n + 1)))))
SELECT *, {_SUM.format(x="lots")} AS held FROM sim WHERE n > 0
"""
PARTS["o_carry"] = f"""
SELECT *, lost_profit + excess_value + holding_cost AS total_cost FROM (
  SELECT 'Nhiều kỳ (có chuyển tồn)' AS mode, policy, sum(bought) AS units_ordered, sum(miss) AS units_short, sum(expired) AS units_excess,
         count(*) FILTER (WHERE y > 0 AND miss <= 0.5) / CAST(count(*) FILTER (WHERE y > 0) AS DOUBLE) AS service_level,
         1 - sum(miss) / sum(y) AS fill_rate, sum(expired * cost) AS excess_value,
         sum(miss * greatest(price - cost, 0)) AS lost_profit, sum(held * cost) * CAST({R.holding_rate_week!r} AS DOUBLE) AS holding_cost
  FROM o_stock GROUP BY policy)
"""

# The same parts where only these two models may win.
_everyone = "FROM o_metrics WHERE scope = 'Giai đoạn chọn mô hình'"
CHALLENGER_PARTS = {**PARTS, "o_champion": PARTS["o_champion"].replace(_everyone, f"{_everyone} AND model IN ('IMAPA', 'AutoETS')")}
