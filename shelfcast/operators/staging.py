"""Cleaning of raw sales lines: deduplication, repairs, costs, flags and sales channels."""

from __future__ import annotations

from functools import partial
from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.functions.joins import left_join_where
from shelfcast.functions.medians import banded_median, counted_median
from shelfcast.functions.running import median_before
from shelfcast.functions.tables import side_by_side, written
from shelfcast.functions.scans import ordered_running
from shelfcast.params import (
    BULK, COST_ACTUAL, COST_CATEGORY, COST_SKU, CREDIT_NOTES, DELETED_MARK, INTERNAL,
    INTERNAL_NOTES, OPENING_PROMO, OPENING_PROMO_MISSPELT, ORGANIZATION, ORGANIZATION_NOTES,
    RETAIL, Rules, UNKNOWN_BRAND,
)

LINE_KEY = ["invoice_id", "sold_at", "sku"]
# True on the lines of invoices that are big as a whole, else null.
BIG_INVOICE = "_big_invoice"
# The eight digits after the type in an invoice id, where a source has spread its lines by them.
INVOICE_NO = "_invoice_no"
# Hash codes of articles with a line big enough to be bulk; as a written table at most about 1 MB.
CANDIDATE_CODES = 1 << 17

STAGED_COLUMNS = (
    "invoice_id", "invoice_base_id", "invoice_type", "is_edited_invoice",
    "sold_at", "sale_date", "sale_hour", "iso_weekday",
    "branch", "seller_code", "seller_active",
    "sku", "sku_deleted", "barcode", "product_name", "brand",
    "category_path", "cat_l1", "cat_l2", "cat_l3",
    "quantity", "unit_price", "unit_cost", "cost_missing", "note",
    "unit_cost_filled", "cost_fill_method", "is_cost_suspect",
    "line_revenue", "line_cogs", "line_profit",
    "is_return", "is_zero_price", "is_opening_promo", "is_fractional_qty", "is_credit_sale",
    "txn_channel",
)


# --- rows and text -----------------------------------------------------------------------

def dedup_latest(raw: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Keep the latest load of each (invoice, time, article); a total order settles ties.

    `row_number() = 1` lets Spark drop all but one copy per task before the shuffle, so a
    line loaded a million times costs one row per map task. `within` names columns that follow from
    the key and by which the lines are partitioned already.
    """
    latest = Window.partitionBy(*within, *LINE_KEY).orderBy(*[
        F.col(c).desc_nulls_last() for c in ("loaded_at", "source_hash", "unit_price", "quantity", "unit_cost")])
    return raw.withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") == 1).drop("_rn")


def repair_category(lines: DataFrame, rules: Rules) -> DataFrame:
    """Trim the path, map the known wrong paths, fix the misspelt promotion name."""
    fixes = F.create_map(*[F.lit(x) for x in chain.from_iterable(rules.category_fixes.items())])
    path = F.trim("category_path")
    repaired = F.replace(F.coalesce(fixes[path], path), F.lit(OPENING_PROMO_MISSPELT), F.lit(OPENING_PROMO))
    return lines.withColumn("category_path", repaired)


def clean_base(raw: DataFrame, rules: Rules) -> DataFrame:
    """Deduplicated, category-repaired lines with the columns staging needs, and `_big_invoice`.

    Lines move once, to their invoice: copies of a line meet there, and the invoice is summed there, so
    that no later step moves wide lines by invoice again. Lines without an invoice belong together in
    nothing; they are spread by time and article. Where a source gives the number in its invoice ids, Spark
    moves lines by that unless they are spread by it already: lines of one id have one number, which every
    line is held to.
    """
    columns = ["invoice_id", "sold_at", "branch", "seller", "note", "sku", "barcode", "product_name",
               "brand", "category_path", "quantity", "unit_price", "unit_cost"]
    if INVOICE_NO in raw.columns:
        home = [INVOICE_NO, "invoice_id"]
        same = F.col(INVOICE_NO).eqNullSafe(F.substring("invoice_id", 3, 8))
        lines = raw.withColumn("invoice_id", F.when(same, F.col("invoice_id")).otherwise(
            F.raise_error(F.lit("an invoice id does not hold the number of its line")).cast("string"))).select(*columns, "loaded_at", "source_hash", INVOICE_NO)
    else:
        lone = F.when(F.col("invoice_id").isNull(), F.xxhash64("sold_at", "sku"))
        home = ["invoice_id", "_lone"]
        lines = raw.select(*columns, "loaded_at", "source_hash", lone.alias("_lone")).repartition(*home)
    kept = repair_category(dedup_latest(lines, within=tuple(home)), rules)
    invoice = Window.partitionBy(*home)
    qty, value = F.sum("quantity").over(invoice), F.sum(F.col("quantity") * F.col("unit_price")).over(invoice)
    big = kept.withColumns({"invoice_qty": qty, "invoice_value": value}).withColumn(
        BIG_INVOICE, F.when(F.col("invoice_id").isNotNull() & big_invoice(rules), F.lit(True)))
    return big.select(*columns, BIG_INVOICE)


def category_levels(lines: DataFrame) -> DataFrame:
    """Split the path; a missing level takes the name of the level above."""
    level = lambda i: F.nullif(F.get("_levels", F.lit(i)), F.lit(""))
    return (
        lines.withColumn("_levels", F.split("category_path", ">>"))
        .withColumn("cat_l1", F.get("_levels", F.lit(0)))
        .withColumn("cat_l2", F.coalesce(level(1), "cat_l1"))
        .withColumn("cat_l3", F.coalesce(level(2), "cat_l2"))
        .drop("_levels")
    )


def invoice_base(lines: DataFrame) -> DataFrame:
    return lines.withColumn("invoice_base_id", F.split_part("invoice_id", F.lit("."), F.lit(1)))


def invoice_attributes(lines: DataFrame) -> DataFrame:
    invoice = F.col("invoice_id")
    return (
        invoice_base(lines)
        .withColumn("invoice_type", F.when(invoice.startswith("TH"), "return").otherwise("sale"))
        .withColumn("is_edited_invoice", invoice.contains("."))
    )


def clean_sku(column: str | Column = "sku") -> Column:
    return F.replace(column, F.lit(DELETED_MARK), F.lit(""))


def product_attributes(lines: DataFrame) -> DataFrame:
    """Deleted mark off the article code, trimmed name, default brand."""
    return (
        lines.withColumn("sku_deleted", F.col("sku").contains(DELETED_MARK))
        .withColumn("sku", clean_sku())
        .withColumn("product_name", F.trim("product_name"))
        .withColumn("brand", F.coalesce(F.nullif(F.trim("brand"), F.lit("")), F.lit(UNKNOWN_BRAND)))
    )


def time_attributes(lines: DataFrame) -> DataFrame:
    return (
        lines.withColumn("sale_date", F.to_date("sold_at"))
        .withColumn("sale_hour", F.hour("sold_at"))
        .withColumn("iso_weekday", F.weekday("sold_at") + 1)
    )


# --- sellers -------------------------------------------------------------------------------

def seller_codes(lines: DataFrame) -> DataFrame:
    """Pseudonyms NV01, NV02, ... by falling line count, then by name.

    Lines without a seller take a number in the order, as one more seller, but get no code.
    """
    sellers = lines.groupBy("seller").agg(F.count(F.lit(1)).alias("n_lines"))
    ranked = ordered_running(sellers, [F.col("n_lines").desc(), F.col("seller").asc_nulls_last()], {}, rank="rank")
    number = F.col("rank").cast("string")
    padded = F.lpad(number, F.greatest(F.length(number), F.lit(2)), F.lit("0"))
    return ranked.filter(F.col("seller").isNotNull()).select("seller", F.concat(F.lit("NV"), padded).alias("seller_code"))


# --- costs ---------------------------------------------------------------------------------

def unknown_cost() -> Column:
    return ~F.coalesce(F.col("unit_cost") > 0, F.lit(False))


def cost_lookups(lines: DataFrame) -> list[tuple[DataFrame, list[str]]]:
    """Median known cost per article (the code as sold, deleted mark included), and median
    cost share of the price per category path."""
    known = lines.filter(F.col("unit_cost") > 0)
    by_article = counted_median(known, ["sku"], "unit_cost", "_article_cost")
    shares = known.filter(F.col("unit_price") > 0).withColumn("_share", F.col("unit_cost") / F.col("unit_price"))
    by_category = banded_median(shares, ["category_path"], "_share", "_cost_share")
    return [(by_article, ["sku"]), (by_category, ["category_path"])]


def with_filled_cost(looked_up: DataFrame) -> DataFrame:
    """Own cost, else the article's median, else price times the category's cost share."""
    unknown = unknown_cost()
    return (
        looked_up
        .withColumn("unit_cost_filled",
                    F.when(~unknown, F.col("unit_cost"))
                    .otherwise(F.coalesce("_article_cost", F.col("unit_price") * F.col("_cost_share"))))
        .withColumn("cost_fill_method",
                    F.when(~unknown, COST_ACTUAL).when(F.col("_article_cost").isNotNull(), COST_SKU)
                    .when(F.col("_cost_share").isNotNull(), COST_CATEGORY))
        .withColumn("cost_missing", F.col("unit_cost") == 0)
        .drop("_article_cost", "_cost_share")
    )


def fill_costs(lines: DataFrame) -> DataFrame:
    """Only the few lines without a cost are joined; all others pass through unshuffled."""
    return with_filled_cost(left_join_where(lines, unknown_cost(), cost_lookups(lines)))


def drop_suspect_costs(lines: DataFrame, rules: Rules) -> DataFrame:
    """A cost far above the price is a unit error: forget it and flag the line."""
    too_high = (F.col("unit_price") > 0) & (F.col("unit_cost_filled") > rules.suspect_cost_ratio * F.col("unit_price"))
    trusted = ~F.col("is_cost_suspect")
    return (
        lines.withColumn("is_cost_suspect", F.coalesce(too_high, F.lit(False)))
        .withColumn("unit_cost_filled", F.when(trusted, F.col("unit_cost_filled")))
        .withColumn("cost_fill_method", F.when(trusted, F.col("cost_fill_method")))
    )


def line_money(lines: DataFrame) -> DataFrame:
    """Revenue, cost and profit of the line; the last two are null for a forgotten cost."""
    trusted = ~F.col("is_cost_suspect")
    return (
        lines.withColumn("line_revenue", F.col("quantity") * F.col("unit_price"))
        .withColumn("line_cogs", F.when(trusted, F.col("quantity") * F.col("unit_cost_filled")))
        .withColumn("line_profit", F.when(
            trusted, F.col("quantity") * (F.col("unit_price") - F.col("unit_cost_filled"))))
    )


# --- flags and channels ---------------------------------------------------------------------

def lowered_note() -> Column:
    return F.coalesce(F.lower(F.trim("note")), F.lit(""))


def quality_flags(lines: DataFrame) -> DataFrame:
    """Needs invoice_type and cat_l1. No flag is ever null."""
    note = lowered_note()
    sure = lambda c: F.coalesce(c, F.lit(False))
    return (
        lines.withColumn("is_return", F.col("invoice_type") == "return")
        .withColumn("is_zero_price", sure((F.col("unit_price") == 0) & (F.col("invoice_type") == "sale")))
        .withColumn("is_opening_promo", sure(F.col("cat_l1") == OPENING_PROMO))
        .withColumn("is_fractional_qty", sure(F.col("quantity") != F.floor("quantity")))
        .withColumn("is_credit_sale", note.contains(CREDIT_NOTES[0]) | note.contains(CREDIT_NOTES[1]))
    )


def prior_median_quantity(lines: DataFrame, rules: Rules) -> DataFrame:
    """(invoice, time, article as sold) with the median positive quantity of the clean
    article strictly before the line. No look-ahead; the article as sold settles ties."""
    narrow = lines.select(
        *LINE_KEY, clean_sku().alias("_clean"),
        F.when(F.col("quantity") > 0, F.col("quantity")).alias("_positive"), "quantity")
    order = [F.col("sold_at"), F.col("invoice_id"), F.col("sku")]
    return (
        median_before(narrow, "_clean", "sold_at", order, "_positive", "prior_median_qty", rules.hot_key_rows)
        .select(*LINE_KEY, "quantity", "prior_median_qty")
    )


def invoice_size(lines: DataFrame) -> DataFrame:
    return lines.groupBy("invoice_id").agg(
        F.sum("quantity").alias("invoice_qty"),
        F.sum(F.col("quantity") * F.col("unit_price")).alias("invoice_value"))


def bulk_candidate(rules: Rules) -> Column:
    return F.col("quantity") >= rules.bulk_line_units


def bulk_lines(lines: DataFrame, rules: Rules) -> DataFrame:
    """Keys of lines that are big in themselves and against the article's own history.

    Only articles with such a line have their history looked at, up to the last of them: nothing later
    can be before one. Lines without a time come first in any history. Articles are known by a hash code:
    the list of codes is small however many articles there are, so that lines need not move to meet it, and
    an article of the same code is looked at for nothing.
    """
    code = F.pmod(F.xxhash64(clean_sku()), F.lit(CANDIDATE_CODES)).cast("int")
    articles = written(
        lines.filter(bulk_candidate(rules)).groupBy(code.alias("_candidate")).agg(F.max("sold_at").alias("_last")), "bulk_articles")
    seen = F.col("sold_at").isNull() | (F.col("sold_at") <= F.col("_last"))
    history = lines.join(articles, (code == F.col("_candidate")) & seen).select(*lines.columns)
    return (
        prior_median_quantity(history, rules)
        .filter(bulk_candidate(rules) & (F.col("quantity") >= rules.bulk_line_ratio * F.col("prior_median_qty")))
        .select(*LINE_KEY, F.lit(True).alias("_big_line"))
    )


def big_invoice(rules: Rules) -> Column:
    return (F.col("invoice_qty") >= rules.bulk_invoice_units) | (F.col("invoice_value") >= rules.bulk_invoice_value)


def bulk_invoices(lines: DataFrame, rules: Rules) -> DataFrame:
    """Ids of invoices that are big as a whole."""
    return invoice_size(lines).filter(big_invoice(rules)).select("invoice_id", F.lit(True).alias(BIG_INVOICE))


def with_big_invoices(lines: DataFrame, rules: Rules) -> DataFrame:
    """`lines` with `_big_invoice`, which those of `clean_base` have already."""
    if BIG_INVOICE in lines.columns:
        return lines
    return lines.join(written(bulk_invoices(lines, rules), "bulk_invoices"), "invoice_id", "left")


def with_channel(marked: DataFrame) -> DataFrame:
    """First match wins: internal note, organisation note, bulk invoice or line, retail."""
    note, sale = lowered_note(), ~F.col("invoice_id").startswith("TH")
    return marked.withColumn(
        "txn_channel",
        F.when(note.rlike("|".join(INTERNAL_NOTES)), INTERNAL)
        .when(note.rlike("|".join(ORGANIZATION_NOTES)), ORGANIZATION)
        .when(sale & (F.col("_big_invoice") | F.col("_big_line")), BULK)
        .otherwise(RETAIL),
    ).drop("_big_invoice", "_big_line")


def classify_channel(lines: DataFrame, rules: Rules) -> DataFrame:
    """Only ids of bulk invoices and keys of bulk lines reach the joins, and only lines big
    enough to be bulk take part in the second one. Needs the article code as sold."""
    marked = left_join_where(lines, bulk_candidate(rules), [(bulk_lines(lines, rules), LINE_KEY)])
    return with_channel(with_big_invoices(marked, rules))


# --- the whole chain ------------------------------------------------------------------------

def stage_lines(base: DataFrame, rules: Rules) -> DataFrame:
    """All cleaning steps on `clean_base` output. Write `base` first: it is read repeatedly.

    One split serves both rare cases (no cost, bulk candidate): the common lines are scanned
    once and meet only the join with the seller codes.
    """
    rare = unknown_cost() | bulk_candidate(rules)
    # Each lookup reads its few columns once and is written, so that the final plan scans the
    # lines twice (rare and common), knows the size of what it joins, and moves wide lines only
    # where a lookup has outgrown a broadcast. None needs another: they are built side by side.
    found, keys = zip(*cost_lookups(base))
    big_lines, sellers, *costs = side_by_side(
        lambda: written(bulk_lines(base, rules), "bulk_lines"), lambda: written(seller_codes(base), "seller_codes"), *[partial(written, table, "costs") for table in found])
    lines = with_big_invoices(base, rules)
    looked_up = left_join_where(lines, rare, [*zip(costs, keys), (big_lines, LINE_KEY)])
    classified = with_channel(with_filled_cost(looked_up))
    coded = classified.join(sellers, "seller", "left").withColumn(
        "seller_active", ~F.col("seller").contains(DELETED_MARK))
    described = product_attributes(category_levels(time_attributes(invoice_attributes(coded))))
    return quality_flags(line_money(drop_suspect_costs(described, rules))).select(*STAGED_COLUMNS)


# --- the stored form --------------------------------------------------------------------------

def packed(staged: DataFrame) -> DataFrame:
    """What has to be stored of staged lines: money and known costs follow from the other columns."""
    return staged.withColumn("_found_cost", F.when(unknown_cost(), F.col("unit_cost_filled"))).drop(
        "invoice_base_id", "unit_cost_filled", "line_revenue", "line_cogs", "line_profit")


def unpacked(stored: DataFrame) -> DataFrame:
    """Staged lines from what `packed` has left of them."""
    cost = F.when(~F.col("is_cost_suspect"), F.when(unknown_cost(), F.col("_found_cost")).otherwise(F.col("unit_cost")))
    return invoice_base(line_money(stored.withColumn("unit_cost_filled", cost))).select(*STAGED_COLUMNS)


# --- derived staging tables -------------------------------------------------------------------

def standard_retail() -> Column:
    """Ordinary retail demand: no return, no gift, no opening promotion."""
    return ((F.col("txn_channel") == RETAIL) & ~F.col("is_return") & ~F.col("is_zero_price")
            & ~F.col("is_opening_promo"))


def retail_sale() -> Column:
    return (F.col("txn_channel") == RETAIL) & ~F.col("is_return")


def month_of(column: str = "sale_date") -> Column:
    return F.trunc(column, "month")


def year_month_of(column: str = "sale_date") -> Column:
    return F.date_format(column, "yyyy-MM")


def with_usual_price(lines: DataFrame, n_lines: str) -> DataFrame:
    """`lines` with the usual price of their article and month, as `usual_prices` has it. They hold `sku`, `month`,
    `unit_price` and how many sold lines each row stands for, and are partitioned by article and month already."""
    article_month = Window.partitionBy("sku", "month")
    counted = lines.withColumn("_n_lines", F.sum(n_lines).over(Window.partitionBy("sku", "month", "unit_price")))
    best = F.max(F.struct("_n_lines", "unit_price")).over(article_month)["unit_price"]
    return counted.withColumn("usual_price", best).drop("_n_lines")


def usual_prices(staged: DataFrame) -> DataFrame:
    """Per article and month the price on most lines; the higher price wins a tie."""
    counts = (
        staged.filter(standard_retail())
        .groupBy("sku", month_of().alias("month"), "unit_price").agg(F.count(F.lit(1)).alias("n_lines"))
    )
    return counts.groupBy("sku", "month").agg(
        F.max(F.struct("n_lines", "unit_price"))["unit_price"].alias("usual_price"))


def calendar(staged: DataFrame) -> DataFrame:
    """Every day of the data span; open means any sale invoice of any channel."""
    daily = staged.groupBy("sale_date").agg(
        F.count_distinct(F.when(F.col("invoice_type") == "sale", F.col("invoice_id"))).alias("n_sale_invoices"))
    span = daily.agg(F.min("sale_date").alias("first"), F.max("sale_date").alias("last")).select(
        F.explode(F.sequence("first", "last")).alias("date"))
    day = F.col("date")
    return span.join(daily, day == F.col("sale_date"), "left").select(
        day,
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        year_month_of("date").alias("year_month"),
        (F.weekday(day) + 1).alias("iso_weekday"),
        (F.weekday(day) >= 5).alias("is_weekend"),
        F.coalesce("n_sale_invoices", F.lit(0)).alias("n_sale_invoices"),
        (F.coalesce("n_sale_invoices", F.lit(0)) > 0).alias("is_open"),
    )
