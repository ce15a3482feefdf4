"""Running totals and ranks over one global order, without a one-partition window.

`SUM() OVER (ORDER BY ...)` without PARTITION BY sends the whole table to one task. Here
the table is range-partitioned on the order instead: each slice sorts and scans its own
rows, and only one total per slice travels to give every slice its starting offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.functions.tables import written

SLICE = "_slice"


def ordered_running(df: DataFrame, order: list[Column], sums: dict[str, str], rank: str | None = None) -> DataFrame:
    """Add running totals (`sums`: new column -> summed column) and a 1-based `rank`.

    The order must be total. The slice number is the range partition's id; it is written
    with the rows, because the bounds are sampled and two evaluations could differ.
    """
    sliced = written(df.repartitionByRange(*order).withColumn(SLICE, F.spark_partition_id()), "ordered")
    counted = {**{new: F.sum(old) for new, old in sums.items()}, **({rank: F.count(F.lit(1))} if rank else {})}

    # One row per slice: at most as many rows as shuffle partitions.
    slices = sliced.groupBy(SLICE).agg(*[agg.alias(f"_{new}") for new, agg in counted.items()])
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        F.col(SLICE), *[F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in counted])

    within = Window.partitionBy(SLICE).orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced
    for new, old in sums.items():
        local = local.withColumn(new, F.sum(old).over(so_far))
    if rank:
        local = local.withColumn(rank, F.row_number().over(within))
    joined = local.join(offsets, SLICE)
    return joined.select(
        *df.columns,
        *[(F.col(new) + F.col(f"_{new}")).alias(new) for new in counted])
