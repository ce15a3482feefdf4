"""Analysis tables built from staged lines, the calendar and usual prices."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.functions.holidays import holiday_offset, holiday_window
from shelfcast.functions.medians import median
from shelfcast.functions.scans import ordered_running
from shelfcast.operators.staging import month_of, retail_sale, standard_retail, with_usual_price, year_month_of
from shelfcast.params import (
    BULK, CHANNEL_INTERNAL, CHANNEL_RETAIL, CHANNEL_WHOLESALE, COST_ACTUAL, FREQUENT, INTERNAL,
    NORMAL_DAYS, OCCASIONAL, ONCE, ORGANIZATION, QUADRANT_LOSS, QUADRANT_POTENTIAL, QUADRANT_REVIEW,
    QUADRANT_STAR, QUADRANT_THIN, RETAIL, Rules, WHOLESALE, WHOLE_STORE,
)


def rows() -> Column:
    return F.count(F.lit(1))


def zero_if_null(column: str | Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def open_day_count(calendar: DataFrame) -> Column:
    return calendar.filter("is_open").agg(rows()).scalar()


def open_days_by_month(calendar: DataFrame) -> DataFrame:
    return calendar.groupBy("year_month").agg(F.count_if("is_open").alias("open_days"))


# --- daily demand --------------------------------------------------------------------------

def daily_category(staged: DataFrame, calendar: DataFrame, prices: DataFrame | None, rules: Rules) -> DataFrame:
    """Retail demand per open day and category; days without a sale are zero rows.

    Lines move once, to their article and month, and are summed there per day and price; the usual price is
    found among these sums. Where `prices` are given, lines are joined with them instead.
    Figures are per level-3 name; a name under two parents shows them under both.
    """
    retail = staged.filter(standard_retail())
    usual = F.col("usual_price")
    sold = retail.select(
        F.col("sale_date").alias("date"), "cat_l3", "sku", "unit_price", month_of().alias("month"),
        F.col("quantity").alias("q"), F.col("line_profit").alias("p"))
    if prices is None:
        # One task sums one month of one article row by row; what it keeps is bounded by days, prices and categories.
        article_days = (
            sold.filter(F.col("sku").isNotNull() & F.col("month").isNotNull()).repartition("sku", "month")
            .groupBy("sku", "month", "unit_price", "date", "cat_l3").agg(F.sum("q").alias("q"), F.sum("p").alias("p"), rows().alias("n")))
        priced = with_usual_price(article_days, "n")
    else:
        priced = sold.join(prices, ["sku", "month"])
    figures = (
        priced.groupBy("date", "cat_l3").agg(
            F.sum("q").alias("quantity"), F.sum(F.col("unit_price") * F.col("q")).alias("revenue"), F.sum("p").alias("profit"),
            F.sum(F.when(F.col("unit_price") < rules.discount_cut * usual, F.col("q"))).alias("discounted"),
            F.sum(F.col("unit_price") * F.col("q")).alias("sold_value"),
            F.sum(usual * F.col("q")).alias("usual_value"))
    )
    invoices = (
        retail.filter(F.col("sku").isNotNull() & F.col("unit_price").isNotNull())
        .groupBy(F.col("sale_date").alias("date"), "cat_l3").agg(F.count_distinct("invoice_id").alias("n_invoices"))
    )
    open_days = calendar.filter("is_open").select("date")
    span = open_days.agg(F.struct(F.min("date").alias("first"), F.max("date").alias("last"))).scalar()
    grid = (
        retail.select("cat_l1", "cat_l2", "cat_l3").distinct()
        .withColumn("_span", span)
        .withColumn("date", F.explode(F.sequence("_span.first", "_span.last"))).drop("_span")
        .join(open_days, "date", "left_semi")
    )
    return (
        grid.join(figures, ["date", "cat_l3"], "left").join(invoices, ["date", "cat_l3"], "left")
        .select(
            "date", "cat_l1", "cat_l2", "cat_l3",
            zero_if_null("quantity").alias("quantity"),
            zero_if_null("revenue").alias("revenue"),
            zero_if_null("profit").alias("profit"),
            F.coalesce("n_invoices", F.lit(0)).alias("n_invoices"),
            F.try_divide(zero_if_null("discounted"), F.col("quantity")).alias("promo_qty_share"),
            (1 - F.try_divide("sold_value", "usual_value")).alias("discount_depth"))
    )


def ambiguous_level3(daily: DataFrame) -> DataFrame:
    """Level-3 names that sit under more than one parent, whose figures appear repeatedly."""
    names = daily.select("cat_l1", "cat_l2", "cat_l3").distinct()
    return names.groupBy("cat_l3").agg(rows().alias("n_parents")).filter("n_parents > 1")


def daily_traffic(staged: DataFrame) -> DataFrame:
    return staged.filter(retail_sale()).groupBy(F.col("sale_date").alias("date")).agg(
        F.count_distinct("invoice_id").alias("n_invoices"),
        F.sum("line_revenue").alias("revenue"),
        F.sum("quantity").alias("quantity"))


# --- months and channels --------------------------------------------------------------------

def channel_label() -> Column:
    return (
        F.when(F.col("txn_channel") == RETAIL, CHANNEL_RETAIL)
        .when(F.col("txn_channel").isin(*WHOLESALE), CHANNEL_WHOLESALE)
        .otherwise(CHANNEL_INTERNAL)
    )


def monthly(staged: DataFrame, calendar: DataFrame) -> DataFrame:
    """Revenue of a month includes its returns; its invoice count does not."""
    figures = staged.groupBy(year_month_of().alias("year_month"), channel_label().alias("channel")).agg(
        F.sum("line_revenue").alias("revenue"),
        F.sum(F.when(F.col("cost_fill_method").isNotNull(), F.col("line_profit"))).alias("profit"),
        F.count_distinct(F.when(~F.col("is_return"), F.col("invoice_id"))).alias("n_invoices"),
        F.sum("quantity").alias("quantity"))
    return figures.join(open_days_by_month(calendar), "year_month").withColumn(
        "revenue_per_open_day", F.try_divide("revenue", "open_days"))


def channel_monthly(staged: DataFrame, calendar: DataFrame, rules: Rules) -> DataFrame:
    """Retail invoices per open day by part of the day, next to wholesale orders.

    An invoice whose lines fall into several channels counts under the first by name. The
    channel travels as its place in that order: a number keeps the aggregation hash-based.
    """
    names = F.array(*[F.lit(c) for c in sorted((BULK, INTERNAL, ORGANIZATION, RETAIL))])
    invoices = staged.filter(~F.col("is_return")).groupBy("invoice_id").agg(
        F.get(names, F.min(F.array_position(names, F.col("txn_channel"))).cast("int") - 1).alias("channel"),
        F.min("sale_date").alias("sale_date"),
        F.min("sale_hour").alias("hour"), F.sum("line_revenue").alias("value"))
    retail, hour = F.col("channel") == RETAIL, F.col("hour")
    wholesale = F.col("channel").isin(*WHOLESALE)
    counts = invoices.groupBy(year_month_of().alias("year_month")).agg(
        F.count_if(retail).alias("n_retail"),
        F.count_if(retail & (hour < 12)).alias("n_morning"),
        F.count_if(retail & hour.between(12, 15)).alias("n_midday"),
        F.count_if(retail & (hour >= 16)).alias("n_evening"),
        F.count_if(retail & (F.col("value") >= rules.large_retail_invoice)).alias("retail_inv_500k_plus"),
        F.count_if(wholesale).alias("bulk_orders"),
        F.sum(F.when(wholesale, F.col("value"))).alias("bulk_revenue"))
    per_day = lambda c: F.try_divide(c, "open_days")
    return counts.join(open_days_by_month(calendar), "year_month").select(
        "year_month", "open_days",
        per_day("n_retail").alias("retail_inv_per_day"),
        per_day("n_morning").alias("retail_morning_per_day"),
        per_day("n_midday").alias("retail_midday_per_day"),
        per_day("n_evening").alias("retail_evening_per_day"),
        "retail_inv_500k_plus", "bulk_orders", "bulk_revenue")


def hour_weekday(staged: DataFrame, calendar: DataFrame) -> DataFrame:
    """Average retail invoices and revenue per open day, by weekday and hour."""
    retail = staged.filter(retail_sale())
    # An invoice spread over several days of the same weekday counts once per day.
    per_invoice = retail.groupBy("iso_weekday", "sale_hour", "sale_date", "invoice_id").agg(
        F.sum("line_revenue").alias("revenue"))
    totals = per_invoice.groupBy("iso_weekday", "sale_hour").agg(
        rows().alias("n_invoices"), F.sum("revenue").alias("revenue"))
    days = calendar.filter("is_open").groupBy("iso_weekday").agg(rows().alias("n_days"))
    return totals.join(days, "iso_weekday").select(
        "iso_weekday", "sale_hour",
        (F.col("n_invoices") / F.col("n_days")).alias("avg_invoices"),
        (F.col("revenue") / F.col("n_days")).alias("avg_revenue"),
        "n_days")


# --- articles and categories ------------------------------------------------------------------

def sku_abc(staged: DataFrame, calendar: DataFrame, rules: Rules) -> DataFrame:
    """Classes by retail quantity: A until 80% is reached, B until 95%, then C. The share
    before the article decides, so the article that crosses a cut belongs to the class
    above. Opening promotions stay in, unlike in ordinary retail demand.

    Lines move once, to their article, and shrink to article days there, which bound what a task keeps.
    Names are keys there, because text in an aggregate buffer would turn hashing into sorting.
    """
    sold = staged.filter(retail_sale() & ~F.col("is_zero_price")).select(
        "sku", "product_name", "cat_l1", "cat_l3", "sale_date", "quantity", "line_revenue",
        F.when(F.col("cost_fill_method").isNotNull(), F.col("line_profit")).alias("known_profit"))
    article_days = sold.repartition("sku").groupBy("sku", "product_name", "cat_l1", "cat_l3", "sale_date").agg(
        F.sum("quantity").alias("quantity"), F.sum("line_revenue").alias("revenue"),
        F.sum("known_profit").alias("profit"))
    articles = (
        article_days.groupBy("sku").agg(
            F.max("product_name").alias("product_name"), F.max("cat_l1").alias("cat_l1"),
            F.max("cat_l3").alias("cat_l3"),
            F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"),
            F.count_distinct("sale_date").alias("days_sold"),
            F.min("sale_date").alias("first_sale"), F.max("sale_date").alias("last_sale"))
        .filter("quantity > 0")
    )
    ranked = ordered_running(articles, [F.col("quantity").desc(), F.col("sku").asc()],
                             {"_running": "quantity"}, rank="qty_rank")
    total = ranked.agg(F.sum("quantity")).scalar()
    cut_a, cut_b = rules.abc_cuts
    before = F.col("cum_qty_share") - F.col("quantity") / F.col("_total")
    return (
        ranked.withColumn("_total", total)
        .withColumn("cum_qty_share", F.col("_running") / F.col("_total"))
        .withColumn("sell_day_ratio", F.try_divide(F.col("days_sold"), open_day_count(calendar)))
        .withColumn("abc_class", F.when(before < cut_a, "A").when(before < cut_b, "B").otherwise("C"))
        .drop("_total", "_running")
    )


def category_margin(staged: DataFrame, until: date | str | None = None, actual_cost_only: bool = False) -> DataFrame:
    """Revenue and margin per level-2 category with its quadrant.

    `until` and `actual_cost_only` restrict it to what was known on a date, so that a
    backtest does not see later data or filled costs.
    """
    lines = staged.filter(
        (F.col("txn_channel") != INTERNAL) & F.col("cost_fill_method").isNotNull() & ~F.col("is_opening_promo"))
    if until is not None:
        lines = lines.filter(F.col("sale_date") <= F.lit(until).cast("date"))
    if actual_cost_only:
        lines = lines.filter(F.col("cost_fill_method") == COST_ACTUAL)
    retail = F.col("txn_channel") == RETAIL
    categories = (
        lines.groupBy("cat_l1", "cat_l2").agg(
            F.sum("line_revenue").alias("revenue"), F.sum("line_profit").alias("profit"),
            F.sum(F.when(retail, F.col("line_profit"))).alias("retail_profit"),
            F.sum(F.when(retail, F.col("line_revenue"))).alias("retail_revenue"),
            F.count_distinct("sku").alias("n_sku"))
        .filter("revenue > 0")
    )
    store = categories.agg(F.struct(
        median("revenue").alias("rev_median"),
        (F.sum("profit") / F.sum("revenue")).alias("store_margin"),
        F.sum("revenue").alias("revenue"))).scalar()
    sells_well = F.col("revenue") >= F.col("rev_median")
    earns_well = F.col("margin") >= F.col("store_margin")
    return (
        categories.withColumn("_store", store)
        .select(
            "cat_l1", "cat_l2", "revenue", "profit",
            F.try_divide("retail_profit", "retail_revenue").alias("retail_margin"),
            (F.col("retail_revenue") / F.col("revenue")).alias("retail_share"),
            "n_sku",
            (F.col("profit") / F.col("revenue")).alias("margin"),
            (F.col("revenue") / F.col("_store.revenue")).alias("revenue_share"),
            F.col("_store.rev_median").alias("rev_median"),
            F.col("_store.store_margin").alias("store_margin"))
        .withColumn(
            "quadrant",
            F.when(F.col("profit") < 0, QUADRANT_LOSS)
            .when(sells_well & earns_well, QUADRANT_STAR)
            .when(sells_well, QUADRANT_THIN)
            .when(earns_well, QUADRANT_POTENTIAL)
            .otherwise(QUADRANT_REVIEW))
    )


def holiday_effect(daily: DataFrame, rules: Rules) -> DataFrame:
    """Mean day before and after a holiday against the mean ordinary day, per top category
    and for the whole store."""
    per_category = (
        daily.groupBy("date", "cat_l1").agg(F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"))
        .withColumn("holiday_window", holiday_window(holiday_offset("date", rules), rules, NORMAL_DAYS))
    )
    per_store = (
        per_category.groupBy("date", "holiday_window")
        .agg(F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"))
        .withColumn("cat_l1", F.lit(WHOLE_STORE))
    )
    # Both parts hold one row per scope and day, so one aggregate serves them.
    means = per_category.unionByName(per_store).groupBy("cat_l1", "holiday_window").agg(
        rows().alias("n_days"), F.avg("quantity").alias("qty_per_day"), F.avg("revenue").alias("rev_per_day"))
    base = Window.partitionBy("cat_l1")
    ordinary = F.col("holiday_window") == NORMAL_DAYS
    return (
        means
        .withColumn("_has_base", F.max(ordinary).over(base))
        .withColumn("_qty", F.max(F.when(ordinary, F.col("qty_per_day"))).over(base))
        .withColumn("_rev", F.max(F.when(ordinary, F.col("rev_per_day"))).over(base))
        .filter(F.col("_has_base") & ~ordinary)
        .select(
            "cat_l1", "holiday_window", "n_days", "qty_per_day", "rev_per_day",
            F.try_divide("qty_per_day", "_qty").alias("qty_factor"),
            F.try_divide("rev_per_day", "_rev").alias("rev_factor"))
    )


# --- wholesale ---------------------------------------------------------------------------------

def wholesale_purchases(staged: DataFrame) -> DataFrame:
    """One row per article in a wholesale invoice."""
    return (
        staged.filter(
            F.col("txn_channel").isin(*WHOLESALE) & ~F.col("is_return") & ~F.col("is_zero_price")
            & (F.col("quantity") > 0))
        .groupBy("invoice_id", "sku").agg(
            F.min("sale_date").alias("sale_date"), F.sum("quantity").alias("qty"),
            F.sum("line_revenue").alias("revenue"), median("unit_cost_filled").alias("unit_cost"))
    )


def month_count(staged: DataFrame) -> Column:
    return staged.agg(F.count_distinct(month_of())).scalar()


def bulk_sku(staged: DataFrame) -> DataFrame:
    """Which articles wholesale buyers take, how often, how much, and what to hold ready."""
    profile = (
        wholesale_purchases(staged).withColumn("month", month_of()).groupBy("sku").agg(
            rows().alias("n_bulk_orders"), F.count_distinct("month").alias("n_bulk_months"),
            F.sum("qty").alias("bulk_qty"), median("qty").alias("median_qty_per_order"),
            F.max("qty").alias("max_qty_per_order"), F.sum("revenue").alias("bulk_revenue"),
            F.max("sale_date").alias("last_bulk_date"), median("unit_cost").alias("unit_cost"))
    )
    # Names of the latest sale and the retail quantity come from one more pass, shrunk to one
    # row per article and set of names before the names are compared.
    retail = retail_sale() & ~F.col("is_zero_price")
    named = staged.groupBy("sku", "product_name", "cat_l1", "cat_l3").agg(
        F.max("sold_at").alias("sold_at"), F.sum(F.when(retail, F.col("quantity"))).alias("retail_qty"))
    latest = F.max(F.struct("sold_at", "product_name", "cat_l1", "cat_l3"))
    articles = named.groupBy("sku").agg(latest.alias("_latest"), F.sum("retail_qty").alias("retail_qty")).select(
        "sku", "_latest.product_name", "_latest.cat_l1", "_latest.cat_l3", "retail_qty")
    frequent = F.col("n_bulk_months") * 2 >= F.col("n_data_months")
    reserve = F.ceil("median_qty_per_order").cast("double")
    return (
        profile.join(articles, "sku").withColumn("n_data_months", month_count(staged))
        .withColumn("retail_qty", zero_if_null("retail_qty"))
        .select(
            "sku", "product_name", "cat_l1", "cat_l3", "n_bulk_orders", "n_bulk_months", "n_data_months",
            "bulk_qty", "median_qty_per_order", "max_qty_per_order", "bulk_revenue", "retail_qty",
            F.try_divide("bulk_qty", F.col("bulk_qty") + F.col("retail_qty")).alias("bulk_share_qty"),
            "last_bulk_date",
            F.when(frequent, FREQUENT).when(F.col("n_bulk_orders") >= 2, OCCASIONAL).otherwise(ONCE)
            .alias("bulk_frequency"),
            F.when(frequent, reserve).otherwise(F.lit(0.0)).alias("reserve_qty"),
            "unit_cost",
            F.when(frequent, reserve * F.col("unit_cost")).otherwise(F.lit(0.0)).alias("reserve_value"))
    )


def bulk_backtest(staged: DataFrame, rules: Rules) -> DataFrame:
    """Would reserves learned on the earlier months have served the last months' purchases?

    Long form (ord, metric, value). The purchases are read once: per article the training
    and the test side sit in the same aggregate, the test purchases as a list of sums.
    """
    test_months = rules.reserve_test_months
    cut = staged.agg(F.struct(
        F.add_months(month_of(F.max("sale_date")), 1 - test_months).alias("test_start"),
        (F.count_distinct(month_of()) - test_months).alias("train_months"))).scalar()
    purchases = wholesale_purchases(staged).withColumn("_cut", cut).withColumn(
        "_test", F.col("sale_date") >= F.col("_cut.test_start"))
    training = ~F.col("_test")
    learned = (
        purchases.groupBy("sku").agg(
            F.count_distinct(F.when(training, month_of())).alias("n_months"),
            F.ceil(median(F.when(training, F.col("qty")))).cast("double").alias("reserve_qty"),
            median(F.when(training, F.col("unit_cost"))).alias("unit_cost"),
            F.max(training).alias("_trained"))
        .withColumn("_cut", cut)
        .filter(F.col("_trained") & (F.col("n_months") * 2 >= F.col("_cut.train_months")))
        .select("sku", "reserve_qty", "unit_cost")
    )
    reserves = learned.agg(F.struct(
        rows().alias("n"), F.sum(F.col("reserve_qty") * F.col("unit_cost")).alias("value"))).scalar()
    frequent, qty = F.col("reserve_qty").isNotNull(), F.col("qty")
    tested = purchases.filter("_test").select("sku", "qty").join(learned.select("sku", "reserve_qty"), "sku", "left")
    one_row = tested.agg(
        F.count_distinct(F.when(frequent, F.col("sku"))).alias("reordered"),
        rows().alias("n"), F.count_if(frequent).alias("n_frequent"),
        F.avg(F.when(frequent, (qty <= F.col("reserve_qty")).cast("double"))).alias("fully_covered"),
        F.sum(F.when(frequent, F.least(qty, "reserve_qty"))).alias("covered_qty"),
        F.sum(F.when(frequent, qty)).alias("frequent_qty"), F.sum("qty").alias("qty"))
    metrics = [
        ("test_start", F.unix_timestamp(F.col("_cut.test_start").cast("timestamp"))),
        ("train_months", F.col("_cut.train_months")),
        ("frequent_skus", F.col("_reserves.n")),
        ("reserve_value", F.col("_reserves.value")),
        ("frequent_skus_reordered", F.col("reordered")),
        ("test_purchases", F.col("n")),
        ("test_purchases_frequent", F.col("n_frequent")),
        ("share_purchases_fully_covered", F.col("fully_covered")),
        ("share_qty_covered", F.try_divide("covered_qty", "frequent_qty")),
        ("share_bulk_qty_of_frequent", F.try_divide("frequent_qty", "qty")),
    ]
    long = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(name).alias("metric"), value.cast("double").alias("value"))
        for i, (name, value) in enumerate(metrics, start=1)])
    return one_row.withColumn("_cut", cut).withColumn("_reserves", reserves).select(F.inline(long))


# --- prices and shares ----------------------------------------------------------------------------

def price_response(daily: DataFrame) -> DataFrame:
    """Sales on discounted days against ordinary days, relative to each category's own mean
    selling day; own slope per top category and one slope for the store."""
    selling = daily.filter((F.col("quantity") > 0) & F.col("discount_depth").isNotNull())
    means = selling.groupBy("cat_l3").agg(F.avg("quantity").alias("_mean"))
    relative = selling.join(means, "cat_l3").withColumn("_rel", F.col("quantity") / F.col("_mean"))
    reduced = F.col("discount_depth") > 0.05
    measures = [
        F.count_if(reduced).alias("discount_days"),
        F.avg(F.when(reduced, F.col("discount_depth"))).alias("avg_depth"),
        F.avg(F.when(reduced, F.col("_rel"))).alias("rel_qty_discount"),
        F.avg(F.when(~reduced, F.col("_rel"))).alias("rel_qty_normal")]
    ratio = F.try_divide("rel_qty_discount", "rel_qty_normal")
    slope = F.greatest(F.try_divide(ratio - 1, F.col("avg_depth") * 100), F.lit(0.0))
    # greatest() skips nulls, so an unknown slope has to be kept null on purpose.
    slope = F.when(ratio.isNotNull() & F.col("avg_depth").isNotNull(), slope)
    store = relative.agg(*measures).select(F.coalesce(slope, F.lit(0.0))).scalar()
    return (
        relative.groupBy("cat_l1").agg(*measures)
        .withColumn("uplift_ratio", ratio).withColumn("uplift_per_pct", slope)
        .withColumn("reliable", F.col("discount_days") >= 30)
        .withColumn("store_uplift_per_pct", store)
    )


def recent_sku_shares(staged: DataFrame, rules: Rules, level: str = "cat_l3") -> DataFrame:
    """Best-selling articles of each category over the last weeks, with their share of the
    category."""
    last_day = staged.agg(F.max("sale_date")).scalar()
    recent = staged.filter(retail_sale() & ~F.col("is_zero_price")).filter(
        F.col("sale_date") > F.date_sub(last_day, rules.share_days))
    sold = (
        recent.groupBy(level, "sku", "product_name").agg(F.sum("quantity").alias("qty"))
        .groupBy(level, "sku").agg(F.max("product_name").alias("product_name"), F.sum("qty").alias("qty"))
    )
    totals = sold.groupBy(level).agg(F.sum("qty").alias("_total"))
    best_first = Window.partitionBy(level).orderBy(F.col("qty").desc(), "sku")
    top = sold.withColumn("rk", F.row_number().over(best_first)).filter(F.col("rk") <= rules.top_skus)
    return top.join(totals, level).select(
        level, "sku", "product_name", "qty", F.try_divide("qty", "_total").alias("share"), "rk")


def category_unit_price(staged: DataFrame, until: date | str | None = None, actual_cost_only: bool = False,
                        level: str = "cat_l3") -> DataFrame:
    """Quantity-weighted mean cost and price of retail sales per category."""
    lines = staged.filter((F.col("txn_channel") == RETAIL) & (F.col("quantity") > 0))
    if until is not None:
        lines = lines.filter(F.col("sale_date") <= F.lit(until).cast("date"))
    if actual_cost_only:
        lines = lines.filter(~F.col("is_zero_price") & (F.col("cost_fill_method") == COST_ACTUAL))
        cost = F.col("unit_cost")
    else:
        lines = lines.filter(F.col("cost_fill_method").isNotNull())
        cost = F.col("unit_cost_filled")
    return lines.groupBy(level).agg(
        (F.sum(F.col("quantity") * cost) / F.sum("quantity")).alias("unit_cost"),
        (F.sum("line_revenue") / F.sum("quantity")).alias("unit_price"))
