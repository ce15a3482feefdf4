"""Queries against their SQL oracles, on the small driver tables and on a skewed copy in
which one article and one order hold a third of all lines each."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfcast.params import BINDING
from shelfcast.plans import all_queries
from shelfcast.plans.layers import Layers
from shelfcast.sources.binding import raw_sales_lines

SMALL = "/root/testdata/sf0.001"
NAMES = ["stg_dedup_latest", "stg_prior_median", "stg_sales_lines", "mart_sku_abc", "mart_bulk_sku",
         "mart_channel_monthly", "mart_hour_weekday", "basket_rules", "stockout_suspects", "dq_reconcile_invoice"]

pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="driver tables are not here")


@pytest.fixture(scope="module", params=["plain", "skewed"])
def data(request, spark, tmp_path_factory):
    folder = SMALL
    if request.param == "skewed":
        folder = str(tmp_path_factory.mktemp("skewed"))
        place = F.pmod(F.xxhash64("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), F.lit(3))
        lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
        lines.withColumn("l_partkey", F.when(place == 0, 7).otherwise(F.col("l_partkey"))).withColumn(
            "l_orderkey", F.when(place == 1, 42).otherwise(F.col("l_orderkey"))
        ).write.parquet(f"{folder}/lineitem.parquet")
        for name in ("orders", "part"):
            spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "orders", "part"):
        path = f"{folder}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    # Cut the history of busy articles into slices, as happens to hot ones at full size.
    return Layers(raw_sales_lines(spark, folder), BINDING.scaled(hot_key_rows=25)), con


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_oracle(data, name):
    layers, con = data
    df = all_queries()[name].run(layers)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert _sorted(tuple(r) for r in df.select(*names).collect()) == _sorted(result.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
