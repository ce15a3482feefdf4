"""Driver tables (lineitem, orders, part) seen as raw point-of-sale lines.

The rules are those of FIXTURES.md section 3, plus an opening-promotion slice and articles without any cost. They use
integer keys and plain IEEE arithmetic only, so any engine reproduces them bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfcast.operators.staging import INVOICE_NO
from shelfcast.params import DELETED_MARK, OPENING_PROMO_MISSPELT
from shelfcast.sources.ingest import CANONICAL_FIELDS

FIRST_LOAD = "2002-01-01 00:00:00"
SECOND_LOAD = "2002-01-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(value: Column) -> Column:
    """Round half up to two decimals with plain double arithmetic."""
    return F.floor(value * 100 + 0.5) / F.lit(100.0)


def _category_path() -> Column:
    l1 = F.col("p_type")
    l2 = F.concat_ws("-", l1, (F.col("p_size") % 5).cast("string"))
    l3 = F.concat_ws("-", l2, (F.col("l_partkey") % 6).cast("string"))
    two_levels = F.concat_ws(">>", l1, l2)
    return (
        F.when(F.col("l_partkey") % 199 == 0,
               F.concat_ws(">>", F.lit(OPENING_PROMO_MISSPELT), F.lit("Quà tặng"), F.lit("Quà tặng")))
        .when(F.col("l_partkey") % 41 == 0, two_levels)
        .when(l3 == "SMALL-4-5", F.lit("SMALL" + DELETED_MARK))
        .otherwise(F.concat_ws(">>", two_levels, l3))
    )


def raw_sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All canonical columns; the month and invoice totals stay null (see `with_totals`)."""
    return numbered_sales_lines(spark, sf_dir).drop(INVOICE_NO)


def numbered_sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw lines with the number in their invoice id, by which the join with the orders has spread them."""
    # Of keys and flags the joins move only what the rules make of them: small numbers, and booleans that rarely hold.
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", (F.col("l_suppkey") % 30).cast("int").alias("supplier_step"), "l_quantity", "l_discount",
        ((F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 25 == 0)).alias("is_return"))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 12).cast("int").alias("clerk"),
        ((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 10 == 0)).alias("is_edited"), "o_orderdate")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")

    order_no, part_no = F.col("l_orderkey"), F.col("l_partkey")
    number = lambda key: F.lpad(F.col(key).cast("string"), 8, "0")
    is_return = F.col("is_return")
    cost_key = order_no * 7 + part_no
    note_key = order_no % 60
    # The repeated slice comes from the same scan: one input row, one or two loads.
    loads = F.when(order_no % 200 == 0, F.array(F.lit("b1"), F.lit("b2"))).otherwise(F.array(F.lit("b1")))

    lines = (
        items
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        # Orders grow with the lines, so this is a shuffle join at any scale, and spreads the wide line building
        # over all cores. It goes by the number alone (long keys share one), so that what partitions by the
        # number finds the lines in place; as a range, the equality of the keys is no further key of the join.
        .join(orders.hint("merge"), (number("l_orderkey") == number("o_orderkey")) & order_no.between(F.col("o_orderkey"), F.col("o_orderkey")))
        .withColumn("source_hash", F.explode(loads))
        .withColumn("sold_at", F.timestamp_add(
            "HOUR", (6 + (order_no * 7) % 16).cast("int"), F.col("o_orderdate")))
    )
    computed = {
        "period_month": F.date_format("sold_at", "MM-yyyy"),
        "invoice_id": F.concat(
            F.when(is_return, "TH").otherwise("HD"),
            number("l_orderkey"),
            F.when(F.col("is_edited"), ".01").otherwise("")),
        "branch": F.lit("CN1"),
        "seller": F.concat(
            F.lit("clerk"), F.col("clerk").cast("string"), F.when(F.col("clerk") == 11, DELETED_MARK).otherwise("")),
        "note": F.when(note_key == 1, "xuất nội bộ").when(note_key == 2, "công ty").when(note_key == 3, "khách nợ"),
        "sold_at": F.col("sold_at"),
        "sku": F.concat(
            F.lpad(part_no.cast("string"), 8, "0"),
            F.when((part_no % 97 == 0) & (order_no % 2 == 0), DELETED_MARK).otherwise("")),
        "product_name": F.col("p_name"),
        "brand": F.when(F.col("p_size") % 3 != 0, F.col("p_brand")),
        "category_path": _category_path(),
        "quantity": F.when(is_return, -F.col("l_quantity")).otherwise(F.col("l_quantity")),
        "unit_price": F.when((order_no * 3 + part_no) % 503 == 0, F.lit(0.0)).otherwise(
            cents(F.col("p_retailprice") * (1 - F.col("l_discount")))),
        "unit_cost": F.when((cost_key % 50 == 0) | (part_no % 151 == 0), F.lit(0.0))
        .when(cost_key % 251 == 0, F.col("p_retailprice") * 5)
        .otherwise(cents(F.col("p_retailprice") * (0.70 + F.col("supplier_step") / F.lit(100.0)))),
    }
    canonical = [
        computed.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in CANONICAL_FIELDS.items()
    ]
    return lines.select(
        *canonical,
        F.concat("source_hash", F.lit(".csv")).alias("source_file"),
        "source_hash",
        F.when(F.col("source_hash") == "b2", SECOND_LOAD).otherwise(FIRST_LOAD).cast("timestamp").alias("loaded_at"),
        number("l_orderkey").alias(INVOICE_NO),
    )


def with_totals(raw: DataFrame) -> DataFrame:
    """Fill the repeated month and invoice revenue totals a sales export carries.

    Totals are pre-aggregated and joined back, so a hot month or invoice never becomes
    one window partition.
    """
    amount = F.sum(F.col("quantity") * F.col("unit_price"))
    first_load = raw.filter(F.col("source_hash") == "b1")
    by_month = first_load.groupBy("period_month").agg(amount.alias("month_revenue"))
    by_invoice = first_load.groupBy("invoice_id").agg(amount.alias("invoice_revenue"))
    return (
        raw.drop("month_revenue", "invoice_revenue")
        .join(by_month, "period_month", "left")
        .join(by_invoice, "invoice_id", "left")
        .select(*raw.columns)
    )
