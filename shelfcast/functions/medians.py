"""Exact medians that stay exact, and stay small in memory, when one group is huge."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.functions.tables import written

SKETCH_ACCURACY = 10_000


def median(column: str | Column) -> Column:
    """Interpolated median for groups whose number of distinct values is small (prices of
    one article, purchase sizes). Spark keeps a value -> count map per group and merges the
    maps of many tasks, so a hot key costs no more than its distinct values."""
    return F.percentile(column, F.lit(0.5))


def counted_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Interpolated median per key where values repeat often (costs, prices). Rows first
    shrink to (key, value, count) by hash aggregation with map-side combine, so neither a
    sort of all rows nor a hot key reaches the median itself."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.percentile(value, F.lit(0.5), F.col("_n")).alias(out))


def banded_quantiles(df: DataFrame, keys: list[str], value: str, taus: list[float], out: str) -> DataFrame:
    """Interpolated quantiles per key, as an array `out`, for values with unbounded distinct counts.

    1. A mergeable sketch per key gives bands that surely hold the ranks asked for.
    2. Rows are counted per (key, value) inside a band and per (key, gap between bands) outside,
       with map-side combine; a hot key spreads over its values.
    3. Only the bands are sorted: about 4 rows in SKETCH_ACCURACY of a key and quantile.
    """
    margin = 2.0 / SKETCH_ACCURACY
    present = df.filter(F.col(value).isNotNull()).select(*keys, value)
    edges = [edge for tau in taus for edge in (max(tau - margin, 0.0), min(tau + margin, 1.0))]
    # Where a band would be narrower than two ranks, all rows of the key are its band. Written, so that the
    # join sees how few keys there are and leaves the rows in place.
    sketched = written(present.groupBy(*keys).agg(
        F.percentile_approx(value, edges, SKETCH_ACCURACY).alias("_edges"), (F.count(F.lit(1)) * margin < 2).alias("_few")), "sketches")
    same_key = reduce(and_, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], F.lit(True))
    inside = F.col("_few") | reduce(or_, [F.col(value).between(F.col("_edges")[2 * i], F.col("_edges")[2 * i + 1]) for i in range(len(taus))])
    placed = present.alias("l").join(sketched.alias("r"), same_key).select(
        *[F.col(f"l.{k}").alias(k) for k in keys],
        # Edges below the value: rows outside every band of one such number lie in one gap.
        F.size(F.filter("_edges", lambda e: e < F.col(value))).alias("_gap"),
        F.when(inside, F.col(value)).alias("_value"))
    counts = placed.groupBy(*keys, "_gap", "_value").agg(F.count(F.lit(1)).alias("_n"))
    # Rows outside come before the edge itself, the largest value of its gap.
    in_order = Window.partitionBy(*keys).orderBy("_gap", F.col("_value").asc_nulls_first())
    ranked = (
        counts.withColumn("_to", F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_to") - F.col("_n") < rank) & (rank <= F.col("_to")), F.col("_value")))

    found = []
    for tau in taus:
        place = (F.col("_total") - 1) * F.lit(tau)
        low = at(F.floor(place) + 1)
        found.append(low + (at(F.ceil(place) + 1) - low) * F.max(place - F.floor(place)))
    return ranked.groupBy(*keys).agg(F.array(*found).alias(out))


def banded_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    return banded_quantiles(df, keys, value, [0.5], out).withColumn(out, F.col(out)[0])
