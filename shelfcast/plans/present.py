"""Result schemas, shared by the Spark queries and their SQL oracles.

A schema is text: `name:kind` pairs. Kinds: s text, i bigint, b boolean, t date as text,
T timestamp as text, d double with 4 decimals, r double with 6 decimals. Rounding keeps a
sum comparable when two engines add the same numbers in a different order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DECIMALS = {"d": 4, "r": 6}
# Added before rounding, so that exact halves fall the same way after either summing order.
NUDGE = 1e-9


def fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in schema.split()]


def _shown(name: str, kind: str) -> Column:
    value = F.col(name)
    if kind in DECIMALS:
        rounded = F.round(value.cast("double") + NUDGE, DECIMALS[kind])
        return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)
    if kind == "t":
        return F.date_format(value, "yyyy-MM-dd")
    if kind == "T":
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    return value.cast({"s": "string", "i": "bigint", "b": "boolean"}[kind])


def present(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[_shown(name, kind).alias(name) for name, kind in fields(schema)])
