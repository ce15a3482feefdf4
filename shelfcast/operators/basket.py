"""Which categories are bought together at ordinary prices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from shelfcast.functions.shipping import shipped
from shelfcast.functions.tables import written
from shelfcast.operators.marts import rows
from shelfcast.operators.staging import month_of, standard_retail
from shelfcast.params import Rules

BLOCK_ROWS = 4096


def baskets(staged: DataFrame, prices: DataFrame, rules: Rules) -> DataFrame:
    """Category sets of invoices with two or more categories, discounted lines left out.

    Lines meet the usual price of their article and month in one join, which splits a hot article;
    lines without one are kept. The set of an invoice is built with map-side combine and is bounded by
    the number of categories.
    """
    lines = staged.filter(standard_retail()).select(
        "invoice_id", "sku", "unit_price", rules.basket_level, month_of().alias("month"))
    discounted = F.col("unit_price") < rules.discount_cut * F.col("usual_price")
    return (
        lines.join(prices, ["sku", "month"], "left").filter(~F.coalesce(discounted, F.lit(False)))
        .groupBy("invoice_id").agg(F.collect_set(rules.basket_level).alias("items"))
        .filter(F.size("items") >= 2)
        .select("items")
    )


def _block_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Co-occurrence of item codes: one small symmetric count matrix per task."""
    counts = np.zeros((0, 0))
    for batch in batches:
        sets = [np.asarray(s, dtype=np.int64) for s in batch["codes"] if len(s) > 1]
        width = max((int(s.max()) + 1 for s in sets), default=0)
        if width > len(counts):
            grown = np.zeros((width, width))
            grown[:len(counts), :len(counts)] = counts
            counts = grown
        for start in range(0, len(sets), BLOCK_ROWS):
            block = sets[start:start + BLOCK_ROWS]
            marks = np.zeros((len(block), len(counts)), dtype=np.float32)
            marks[np.repeat(np.arange(len(block)), [len(s) for s in block]), np.concatenate(block)] = 1
            counts += marks.T @ marks
    first, second = np.nonzero(np.triu(counts, k=1))
    yield pd.DataFrame({"first": first, "second": second, "n": counts[first, second].astype("int64")})


def basket_rules(staged: DataFrame, prices: DataFrame, rules: Rules) -> DataFrame:
    """One-to-one rules by support and lift, one direction per pair (the surer one).

    Items below the support can be in no pair above it, so at most (mean basket size /
    support) items remain: that bounds the code table and every count matrix, whatever the
    number of baskets. Tasks emit summed counts only, never the pairs of a basket.
    """
    shipped(staged.sparkSession)
    sets = written(baskets(staged, prices, rules), "baskets")
    n_baskets = sets.agg(rows()).scalar()
    item_counts = sets.select(F.explode("items").alias("item")).groupBy("item").agg(rows().alias("n"))
    frequent = (
        item_counts.filter(F.col("n") >= rules.min_support * n_baskets)
        .withColumn("code", F.row_number().over(Window.orderBy("item")) - 1)
    )
    frequent = written(frequent, "items")
    codes = frequent.agg(F.map_from_entries(F.collect_list(F.struct("item", "code")))).scalar()
    coded = sets.withColumn("_codes", codes).select(
        F.filter(F.transform("items", lambda i: F.col("_codes")[i]), lambda c: c.isNotNull()).alias("codes"))
    pairs = (
        coded.mapInPandas(_block_counts, "first bigint, second bigint, n bigint")
        .groupBy("first", "second").agg(F.sum("n").alias("n"))
    )
    side = lambda prefix: frequent.select(
        F.col("code").alias(prefix), F.col("item").alias(f"{prefix}_item"), F.col("n").alias(f"{prefix}_n"))
    named = pairs.join(side("first"), "first").join(side("second"), "second").withColumn("_total", n_baskets)
    # The rarer item gives the surer rule; on equal counts the name decides.
    forward = (F.col("first_n") < F.col("second_n")) | (
        (F.col("first_n") == F.col("second_n")) & (F.col("first_item") < F.col("second_item")))
    return (
        named.select(
            F.when(forward, F.col("first_item")).otherwise(F.col("second_item")).alias("antecedent"),
            F.when(forward, F.col("second_item")).otherwise(F.col("first_item")).alias("consequent"),
            (F.col("n") / F.col("_total")).alias("support"),
            (F.col("n") / F.least("first_n", "second_n")).alias("confidence"),
            (F.col("n") * F.col("_total") / (F.col("first_n") * F.col("second_n"))).alias("lift"),
            F.col("n").alias("n_baskets"),
            F.col("_total").alias("total_multi_item_baskets"))
        .filter((F.col("support") >= rules.min_support) & (F.col("lift") >= rules.min_lift))
    )
