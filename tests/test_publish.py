"""Published tables: views over written tables, files without sensitive columns."""

import os

import pytest

from shelfcast.params import BINDING, SENSITIVE_COLUMNS
from shelfcast.plans import publish
from shelfcast.plans.forecast_queries import sink_order_plan
from shelfcast.plans.layers import Layers
from shelfcast.sources.binding import raw_sales_lines

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="driver tables are not here")


@pytest.fixture(scope="module")
def layers(spark):
    # The statistical models are enough here, and quick.
    from shelfcast.operators.forecast import STATISTICAL

    return Layers(raw_sales_lines(spark, SMALL), BINDING).among(STATISTICAL)


def test_views_answer_sql(spark, layers):
    names = ["stg_sales_lines", "dim_date", "mart_monthly", "fc_metrics", "fc_run_info", "fc_order_plan"]
    assert publish.publish_views(layers, names) == names
    assert all(publish.has_table(spark, name) for name in names) and not publish.has_table(spark, "no_such_table")
    months = spark.sql("SELECT count(DISTINCT year_month) AS n FROM mart_monthly WHERE channel = :c", args={"c": "Bán lẻ"})
    assert months.first()["n"] == spark.table("dim_date").select("year_month").distinct().count()
    best = spark.sql("SELECT DISTINCT model FROM fc_metrics WHERE is_champion").collect()
    assert [r["model"] for r in best] == [spark.table("fc_run_info").first()["champion"]]


def test_files_hold_no_sensitive_column_and_the_rest_is_named(spark, layers, tmp_path, monkeypatch):
    monkeypatch.setattr(publish, "forecast_tables", lambda t: {"fc_order_plan": lambda: t.plan})
    published, withheld = publish.publish_folder(layers, str(tmp_path))
    assert "fc_order_plan" in published and "raw_sales_lines" in withheld and not set(published) & set(withheld)
    for name in published:
        assert not SENSITIVE_COLUMNS & set(spark.read.parquet(str(tmp_path / name)).columns)
    assert all(set(columns) <= SENSITIVE_COLUMNS and columns for columns in withheld.values())


def test_a_second_export_leaves_the_first_readable(layers):
    first, second = sink_order_plan(layers), sink_order_plan(layers)
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))
