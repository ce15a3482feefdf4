"""Signed distance to the nearest holiday of a short list, and the window it falls into."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfcast.params import AFTER_HOLIDAY, BEFORE_HOLIDAY, Rules


def holiday_offset(day: str | Column, rules: Rules) -> Column:
    """Days since the nearest holiday, negative before it; the earlier-listed wins a tie."""
    gaps = [F.datediff(day, F.lit(h)) for h in rules.holidays]
    candidates = [F.struct(F.abs(gap).alias("distance"), F.lit(i).alias("place"), gap.alias("offset"))
                  for i, gap in enumerate(gaps)]
    return F.array_min(F.array(*candidates))["offset"]


def holiday_window(offset: Column, rules: Rules, otherwise: str) -> Column:
    return (
        F.when(offset.between(-rules.holiday_before, -1), BEFORE_HOLIDAY)
        .when(offset.between(0, rules.holiday_after), AFTER_HOLIDAY)
        .otherwise(otherwise)
    )


def near_holiday(offset: Column, rules: Rules) -> Column:
    return offset.between(-rules.holiday_before, rules.holiday_after)
