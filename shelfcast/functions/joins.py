"""Joins that shuffle only the rows that can match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def left_join_where(left: DataFrame, condition: Column, lookups: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left join several (table, keys) lookups, only for rows of `left` where `condition` holds.

    All other rows get nulls for the looked-up columns and skip every shuffle. Use it when
    the condition is rare: the wide majority of rows is then only scanned.
    """
    holds = F.coalesce(condition, F.lit(False))
    matched, untouched = left.filter(holds), left.filter(~holds)
    for right, keys in lookups:
        added = [f for f in right.schema.fields if f.name not in keys]
        matched = matched.join(right, keys, "left")
        untouched = untouched.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
    return matched.select(*untouched.columns).unionByName(untouched)
