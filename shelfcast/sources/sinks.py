"""Exports of result tables, with a guard against sensitive columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfcast.params import SENSITIVE_COLUMNS


class SensitiveColumns(ValueError):
    """An export would publish a name, a note or an invoice id."""


def guarded(df: DataFrame, name: str = "table") -> DataFrame:
    leaked = SENSITIVE_COLUMNS & set(df.columns)
    if leaked:
        raise SensitiveColumns(f"{name} holds sensitive columns: {sorted(leaked)}")
    return df


def export_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Write every table as compressed parquet; nothing is written if one table is refused."""
    for name, df in tables.items():
        guarded(df, name)
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder.rstrip('/')}/{name}")


def filtered_plan(plan: DataFrame, cat_l1: list[str] | None = None, confidence: list[str] | None = None,
                  service_class: list[str] | None = None) -> DataFrame:
    """The order plan as a buyer filters it; an empty filter keeps everything."""
    view = plan
    for column, wanted in (("cat_l1", cat_l1), ("confidence", confidence), ("service_class", service_class)):
        if wanted:
            view = view.filter(F.col(column).isin(*wanted))
    return view.withColumn("order_value", F.round("order_value", 0))


def export_plan_csv(view: DataFrame, path: str) -> None:
    guarded(view, "order plan").write.mode("overwrite").option("header", True).csv(path)
