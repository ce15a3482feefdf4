"""Median of everything seen earlier for the same key, exact for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.functions.tables import written


# Keys are first counted by so many hash codes: what a task sends does not grow with its rows.
CODES = 1 << 16


def crowded_keys(lines: DataFrame, key: str, most: int, out: str) -> DataFrame:
    """The keys of more than `most` rows, as a written table with the column `out`.

    A key has no more rows than its hash code has. Only the keys of codes with more than `most` rows are
    counted one by one; without such codes that is an empty join.
    """
    code = F.pmod(F.xxhash64(key), F.lit(CODES)).cast("int")
    many = F.count(F.lit(1)) > most
    codes = written(lines.groupBy(code.alias("_code")).agg(many.alias("_many")).filter("_many").select("_code"), "crowded_codes")
    near = lines.select(key).join(codes, code == F.col("_code"), "left_semi")
    return written(near.groupBy(key).agg(many.alias("_many")).filter("_many").select(F.col(key).alias(out)), "hot_keys")


def median_before(lines: DataFrame, key: str, time: str, order: list[Column], value: str,
                  out: str, hot_rows: int) -> DataFrame:
    """Add `out`: the interpolated median of `value` over the rows of the same `key` that
    come strictly earlier in `order` (whose leading part must be `time`).

    One plan serves keys of any size. The history of a key is cut into consecutive time slices
    of about `hot_rows` rows; most keys have only slice 0. Each later slice starts with a carry:
    how often every value occurred before the slice, as one weighted row per value. The weighted
    median over (carry, rows so far) equals the median over the full history, so nothing is
    approximated and no task sees more than a slice. A null key is a key like any other; rows of
    one key and one second are never parted.
    """
    # Keys with more than one slice, and where their slices start: small tables, written so that
    # the joins see their size and leave the lines in place. Without such keys all that hangs on
    # them is an empty join, which adaptive execution leaves out.
    hot = crowded_keys(lines, key, hot_rows, "_hot")
    second = F.date_trunc("second", time)
    earlier = Window.partitionBy("_hot").orderBy("_second").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        lines.select(key, second.alias("_second")).join(hot, F.col(key).eqNullSafe(F.col("_hot")))
        .groupBy("_hot", "_second").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_slice", F.floor(F.coalesce(F.sum("_n").over(earlier), F.lit(0)) / hot_rows))
        .groupBy("_hot", "_slice").agg(F.min("_second").alias("_from")))
    starts = written(
        slices.groupBy("_hot").agg(F.array_sort(F.collect_list(F.struct("_from", "_slice"))).alias("_starts")), "slice_starts")
    # The slice of a row is the last one that starts no later.
    own = F.element_at(F.filter("_starts", lambda s: s["_from"] <= second), -1)["_slice"]
    same_key = F.col(key).eqNullSafe(F.col("_hot"))
    placed = lines.join(starts, same_key, "left").withColumn("_slice", F.coalesce(own, F.lit(0))).drop("_starts", "_hot")

    # Carry: one row per (key, slice, value), counted before the slice.
    hot_counts = (
        lines.filter(F.col(value).isNotNull()).join(starts, same_key)
        .groupBy("_hot", own.alias("_slice"), F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n")))
    later = starts.select(F.col("_hot").alias("_of"), F.explode("_starts").alias("_s")).select(
        "_of", F.col("_s._slice").alias("_at")).filter("_at > 0")
    carry = (
        hot_counts.join(later, F.col("_hot").eqNullSafe(F.col("_of")) & (F.col("_slice") < F.col("_at")))
        .groupBy(F.col("_of").alias(key), F.col("_at").alias("_slice"), F.col("_value").alias(value))
        .agg(F.sum("_n").alias("_weight")).withColumn("_is_carry", F.lit(True)))

    rows = placed.withColumn("_weight", F.lit(1).cast("bigint")).withColumn("_is_carry", F.lit(False))
    before = (
        Window.partitionBy(key, "_slice").orderBy(F.col("_is_carry").desc(), *order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.unionByName(carry, allowMissingColumns=True)
        .withColumn(out, F.percentile(value, F.lit(0.5), F.col("_weight")).over(before))
        .filter(~F.col("_is_carry"))
        .select(*lines.columns, out)
    )
