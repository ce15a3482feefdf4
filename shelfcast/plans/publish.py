"""All result tables by name: as views for SQL, or as parquet in a folder.

    python -m shelfcast.plans.publish OUT_FOLDER EXPORT.csv [EXPORT.csv ...]
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfcast.functions.tables import written
from shelfcast.operators import basket, evaluate, explain, marts, monitor, policy, stockout
from shelfcast.params import DEFAULT, Rules, SENSITIVE_COLUMNS, SNAPSHOT_LIVE
from shelfcast.plans.layers import Layers
from shelfcast.plans.session import prepared, sized_for
from shelfcast.sources.ingest import read_export
from shelfcast.sources.sinks import export_tables


def base_tables(t: Layers) -> dict[str, Callable[[], DataFrame]]:
    return {
        "raw_sales_lines": lambda: t.raw,
        "stg_sales_lines": lambda: t.staged,
        "dim_date": lambda: t.calendar,
        "sku_month_price": lambda: t.prices,
        "fct_retail_daily_category": lambda: t.daily,
        "mart_monthly": lambda: marts.monthly(t.staged, t.calendar),
        "mart_sku_abc": lambda: marts.sku_abc(t.staged, t.calendar, t.rules),
        "mart_hour_weekday": lambda: marts.hour_weekday(t.staged, t.calendar),
        "mart_category_margin": lambda: marts.category_margin(t.staged),
        "mart_tet_effect": lambda: marts.holiday_effect(t.daily, t.rules).withColumnRenamed("holiday_window", "tet_window"),
        "mart_daily_traffic": lambda: marts.daily_traffic(t.staged),
        "mart_bulk_sku": lambda: marts.bulk_sku(t.staged),
        "mart_bulk_backtest": lambda: marts.bulk_backtest(t.staged, t.rules),
        "mart_channel_monthly": lambda: marts.channel_monthly(t.staged, t.calendar, t.rules),
        "mart_basket_rules": lambda: basket.basket_rules(t.staged, t.prices, t.rules),
        "mart_stockout_suspects": lambda: stockout.stockout_suspects(t.staged, t.calendar, t.rules).withColumnRenamed(
            "entity", t.rules.stockout_entity if t.rules.stockout_entity != "cat_l3" else "entity"),
    }


def forecast_tables(t: Layers) -> dict[str, Callable[[], DataFrame]]:
    scores = lambda: evaluate.metrics(t.weeks).withColumn(
        "is_champion", F.col("model") == t.champion)
    others = lambda: [m for m in t.models if m != t.champion]

    def profile() -> DataFrame:
        classes = policy.service_classes(t.profile, marts.category_margin(t.staged), t.rules)
        scored = t.report.drop("demand_class", "cat_l1", "cat_l2", "confidence")
        return classes.join(scored, "unique_id", "left").withColumn("confidence", evaluate.confidence())

    def simulation() -> DataFrame:
        return policy.single_period(t.policy_weeks).unionByName(
            policy.carry_over(t.policy_weeks, t.rules), allowMissingColumns=True)

    def overall() -> DataFrame:
        rows, categories = t.design
        return explain.global_importance(rows, t.weights, categories)

    def snapshots() -> DataFrame:
        live = monitor.plan_snapshot(
            t.plan, f"run-{t.last_day:%Y%m%d}", SNAPSHOT_LIVE, t.champion, t.last_day, F.current_timestamp())
        return monitor.upsert(monitor.backfill(t.weeks, t.champion), live)

    def allocation() -> DataFrame:
        level = t.rules.series_level
        return policy.allocate(marts.recent_sku_shares(t.staged, t.rules, level), t.plan, level)

    return {
        "fc_profile": profile,
        "fc_metrics": scores,
        "fc_metrics_levels": lambda: evaluate.level_errors(t.weeks),
        "fc_backtest_weekly": lambda: t.weeks,
        "fc_simulation": simulation,
        "fc_significance": lambda: evaluate.significance(t.backtest, t.weeks, t.champion, others(), t.rules.horizon),
        "fc_ratio_quantiles": lambda: t.quantiles,
        "fc_forecast_daily": lambda: t.future_daily,
        "fc_order_plan": lambda: t.plan,
        "fc_sku_allocation": allocation,
        "fc_contributions_global": overall,
        "fc_contributions_local": lambda: t.contributions,
        "fc_price_response": lambda: marts.price_response(t.daily),
        "fc_run_info": lambda: t.run_info().withColumn("run_at", F.current_timestamp()),
        "fc_snapshots": snapshots,
    }


def publish_views(t: Layers, names: list[str] | None = None) -> list[str]:
    """Register tables as temporary views, so that `spark.sql(text, args={...})` can read
    them. Every view reads a written table, not a pending plan."""
    tables = {**base_tables(t), **forecast_tables(t)}
    wanted = names or list(tables)
    stored = {"raw_sales_lines", "stg_sales_lines", "dim_date", "sku_month_price", "fct_retail_daily_category"}
    for name in wanted:
        table = tables[name]()
        # Layers are written tables already.
        (table if name in stored else written(table, name)).createOrReplaceTempView(name)
    return wanted


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def publish_folder(t: Layers, folder: str) -> tuple[list[str], dict[str, list[str]]]:
    """Write every table that holds no sensitive column. Also says which were withheld, and
    for which columns."""
    tables = {name: build() for name, build in {**base_tables(t), **forecast_tables(t)}.items()}
    withheld = {name: sorted(SENSITIVE_COLUMNS & set(df.columns)) for name, df in tables.items() if SENSITIVE_COLUMNS & set(df.columns)}
    safe = {name: df for name, df in tables.items() if name not in withheld}
    export_tables(safe, folder)
    return list(safe), withheld


def main(argv: list[str], rules: Rules = DEFAULT) -> None:
    folder, exports = argv[0], argv[1:]
    spark = sized_for(prepared(SparkSession.builder.appName("shelfcast").getOrCreate()), exports)
    t = Layers(written(read_export(spark, exports), "raw"), rules)
    published, withheld = publish_folder(t, folder)
    for name in published:
        print(name)
    for name, columns in withheld.items():
        print(f"withheld: {name} ({', '.join(columns)})", file=sys.stderr)


if __name__ == "__main__":
    main(sys.argv[1:])
