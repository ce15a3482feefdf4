"""Runs of open days without a sale that chance hardly explains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shelfcast.operators.marts import open_day_count
from shelfcast.operators.staging import retail_sale
from shelfcast.params import Rules, STOCKOUT_CLOSED, STOCKOUT_OPEN


def regular_sellers(staged: DataFrame, calendar: DataFrame, rules: Rules) -> DataFrame:
    """Entities (articles by default) sold on enough of the open days."""
    return (
        staged.filter(retail_sale() & ~F.col("is_zero_price")).groupBy(rules.stockout_entity)
        .agg(F.sum("quantity").alias("_qty"), F.count_distinct("sale_date").alias("_days"))
        .filter((F.col("_qty") > 0) & (F.col("_days") >= rules.min_sell_ratio * open_day_count(calendar)))
        .select(rules.stockout_entity)
    )


def stockout_suspects(staged: DataFrame, calendar: DataFrame, rules: Rules) -> DataFrame:
    """Lines shrink to one row per entity and day first; all windows run on that.

    With a share p of open days with a sale, L days in a row without one have probability
    (1-p)^L; gaps below the limit are reported. A gap can also reach the end of the data.
    """
    entity = rules.stockout_entity
    # One row per open day: bounded by the calendar.
    open_days = calendar.filter("is_open").select(
        "date", F.row_number().over(Window.orderBy("date")).alias("place"))
    sales = (
        staged.filter(retail_sale()).join(regular_sellers(staged, calendar, rules), entity, "left_semi")
        .select(F.col(entity).alias("entity"), F.col("sale_date").alias("date")).distinct()
        .join(open_days, "date")
    )
    names = (
        staged.filter(retail_sale()).select(F.col(entity).alias("entity"), "product_name",
                                            F.col("cat_l3").alias("category")).distinct()
        .groupBy("entity").agg(F.max("product_name").alias("product_name"), F.max("category").alias("cat_l3"))
    )
    own, in_order = Window.partitionBy("entity"), Window.partitionBy("entity").orderBy("place")
    gaps = (
        sales.withColumn("_end", open_day_count(calendar) + 1)
        .withColumn("_next", F.coalesce(F.lead("place").over(in_order), F.col("_end")))
        .withColumn("sell_day_ratio", F.count(F.lit(1)).over(own) / (F.col("_end") - F.min("place").over(own)))
        .withColumn("gap_open_days", F.col("_next") - F.col("place") - 1)
        .withColumn("chance_probability", F.pow(1 - F.col("sell_day_ratio"), F.col("gap_open_days")))
        .filter((F.col("gap_open_days") >= rules.min_gap)
                & (F.col("chance_probability") < rules.max_gap_probability))
    )
    day = lambda name: open_days.select(F.col("date").alias(name), F.col("place").alias(f"_{name}"))
    return (
        gaps.withColumn("_gap_start", F.col("place") + 1).withColumn("_gap_end", F.col("_next") - 1)
        .join(day("gap_start"), "_gap_start").join(day("gap_end"), "_gap_end").join(names, "entity")
        .select(
            "entity", "product_name", "cat_l3", "gap_start", "gap_end", "gap_open_days", "sell_day_ratio",
            "chance_probability",
            F.when(F.col("_next") == F.col("_end"), STOCKOUT_OPEN).otherwise(STOCKOUT_CLOSED).alias("status"))
    )
