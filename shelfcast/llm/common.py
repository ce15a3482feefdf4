"""Helpers the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfcast.functions.tables import written

# monotonically_increasing_id() keeps the row number of a partition in its low 33 bits.
ROW_BITS = 33
# A word is a run of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, so that extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def partition_of(position: Column) -> Column:
    return F.shiftright(position, ROW_BITS)


def row_of(position: Column) -> Column:
    return position.bitwiseAND(F.lit((1 << ROW_BITS) - 1))


def numbered(df: DataFrame, group: str, order: list[Column], number: str, name: str) -> DataFrame:
    """Add each row's 0-based `number` within `group`, in `order`, however large a group is.

    Rows are range-partitioned on (group, order), so one group spreads over many tasks. Each
    row takes its place in its partition, and only one count per (partition, group) travels
    to say how many rows of the group lie before. The table is written in between: the range
    bounds are sampled, and two evaluations could differ. A null group is a group of its own.
    """
    at, slice_, first, before, key = (
        fresh(df, c) for c in ("_position", "_slice", "_first", "_before", "_group"))
    keys = [F.col(group).asc_nulls_last(), *order]
    placed = written(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn(at, F.monotonically_increasing_id()), name)
    counts = placed.groupBy(partition_of(F.col(at)).alias(slice_), F.col(group).alias(key)).agg(
        F.min(at).alias(first), F.count(F.lit(1)).alias(before))
    earlier = Window.partitionBy(key).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    # About one row per partition and group; written, so that its size is known.
    offsets = written(counts.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0))), name + "-offsets")
    same = (partition_of(placed[at]) == offsets[slice_]) & placed[group].eqNullSafe(offsets[key])
    return placed.join(offsets, same).select(
        *[placed[c] for c in df.columns], (F.col(before) + F.col(at) - F.col(first)).alias(number))
