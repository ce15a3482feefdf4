"""What the chain moves and stores: each line once where once is enough, with the rows it had before."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_staging import SCHEMA, plan_of, sale, staged

from shelfcast.functions.running import crowded_keys
from shelfcast.operators import marts, staging
from shelfcast.params import BINDING, DEFAULT
from shelfcast.plans.session import prepared
from shelfcast.sources import binding


def rows_of(df):
    return sorted(map(str, df.collect()))


def mixed_lines(seed=1):
    rng = random.Random(seed)
    lines = [sale(f"{rng.choice(['K', 'K', 'TH'])}{rng.randrange(60)}{rng.choice(['', '.01'])}", rng.choice(["tea", "mug", "rope"]), rng.choice([1, 2, -1, 0.5, 60, 90]),
                  price=rng.choice([37, 37, 30, 0, 9]), cost=rng.choice([21, 0, 500, -1]), day=rng.randrange(50), path=rng.choice(["A>>B>>C", "A>>B", "D"]))
             for _ in range(300)]
    for line in rng.sample(lines, 30):
        line[rng.choice(["unit_cost", "unit_price", "quantity", "sku", "sold_at", "invoice_id", "category_path"])] = None
    return lines


def test_money_and_known_costs_follow_from_what_is_stored(spark):
    done = staged(spark, mixed_lines()).localCheckpoint()
    stored = staging.packed(done)
    assert not {"line_revenue", "line_cogs", "line_profit", "unit_cost_filled"} & set(stored.columns)
    back = staging.unpacked(stored)
    assert back.columns == done.columns and rows_of(back) == rows_of(done)


def test_daily_demand_finds_usual_prices_in_the_same_move(spark):
    done = staged(spark, mixed_lines(2)).localCheckpoint()
    days = staging.calendar(done).localCheckpoint()
    alone = marts.daily_category(done, days, None, DEFAULT)
    joined = marts.daily_category(done, days, staging.usual_prices(done), DEFAULT)
    show = lambda df: rows_of(df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]))
    assert show(alone) == show(joined)
    moves = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(alone).partition("== Physical Plan ==")[2])
    assert sum("sku#" in m for m in moves) == 1 and not any("unit_price#" in m for m in moves)


def test_lines_move_to_their_article_once_for_its_class(spark):
    done = staged(spark, mixed_lines(3)).localCheckpoint()
    sold = []
    marts_running = marts.ordered_running
    marts.ordered_running = lambda df, *rest, **more: sold.append(df) or marts_running(df, *rest, **more)
    try:
        marts.sku_abc(done, staging.calendar(done), DEFAULT)
    finally:
        marts.ordered_running = marts_running
    moves = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(sold[0]).partition("== Physical Plan ==")[2])
    assert len(moves) == 1 and re.match(r"sku#\d+, \d+", moves[0])


def test_crowded_keys_are_exact(spark):
    rng = random.Random(4)
    keys = [rng.choice([None, "a", "b", "c", "d", "e"]) if rng.random() < 0.5 else str(rng.randrange(400)) for _ in range(2000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for most in (0, 4, 100, 170, 5000):
        got = [r["hot"] for r in crowded_keys(df, "k", most, "hot").collect()]
        assert len(got) == len(set(got)) and set(got) == {k for k in keys if keys.count(k) > most}


def test_articles_that_share_a_code_keep_their_big_lines(spark, monkeypatch):
    start, big = datetime(2024, 1, 1), DEFAULT.bulk_line_units
    rng = random.Random(5)
    lines = [{**sale(f"K{i}", f"s{rng.randrange(40)}", rng.choice([1, 2, 3, big, 20 * big])), "sold_at": start + timedelta(hours=rng.randrange(200))}
             for i in range(600)]
    lines += [{**line, "sku": None, "invoice_id": f"N{i}"} for i, line in enumerate(lines[:20])]
    base = staging.clean_base(spark.createDataFrame([tuple(x.values()) for x in lines], SCHEMA), DEFAULT).localCheckpoint()
    want = staging.prior_median_quantity(base, DEFAULT).filter(
        staging.bulk_candidate(DEFAULT) & (F.col("quantity") >= DEFAULT.bulk_line_ratio * F.col("prior_median_qty"))).select(
        *staging.LINE_KEY, F.lit(True).alias("_big_line"))
    for codes in (1, 3, 1 << 17):
        monkeypatch.setattr(staging, "CANDIDATE_CODES", codes)
        found = staging.bulk_lines(base, DEFAULT)
        assert rows_of(found) == rows_of(want) and found.count() > 10
        # The list of codes leaves the lines where they are: they move once, to their history.
        assert "SortMergeJoin" not in plan_of(found)


def test_shuffles_are_deleted_with_their_job(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert prepared(spark).conf.get(key) == "true"
    twice = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert rows_of(twice) == rows_of(twice)  # a result asked for again is made again


def shop(spark, folder):
    """A small lineitem, orders and part; orders come loaded twice, keys repeat, long keys share the number of their invoice."""
    rng = random.Random(6)
    keys = [*range(1, 30), *range(200, 2001, 200), 50, 60, 123456780, 123456781, 1234567811]
    orders = [(k, rng.randrange(40), rng.choice("OPF"), datetime(1997, 1, 1 + rng.randrange(28))) for k in keys + [7]] + [(None, 1, "P", datetime(1997, 1, 1))]
    lines = [(rng.choice(keys), rng.randrange(1, 9), rng.choice([None, *range(35)]), float(rng.randrange(1, 60)), rng.choice([0.0, 0.05]), rng.choice(["R", "N", None]))
             for _ in range(300)] + [(None, 1, 1, 1.0, 0.0, "R"), (5, None, 1, 1.0, 0.0, "R")]
    parts = [(k, f"part {k}", f"Brand#{k}", rng.choice(["SMALL", "LARGE"]), k, 1000.0 + k) for k in [*range(1, 9), 3]]
    for name, rows, columns in (
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp"),
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string"),
            ("part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")):
        spark.createDataFrame(rows, columns).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_numbered_lines_stay_where_their_join_has_put_them(spark, tmp_path):
    folder = shop(spark, tmp_path)
    numbered, plain = binding.numbered_sales_lines(spark, folder), binding.raw_sales_lines(spark, folder)
    assert staging.INVOICE_NO not in plain.columns and rows_of(numbered.drop(staging.INVOICE_NO)) == rows_of(plain)
    items, orders, parts = (binding.table(spark, folder, name) for name in ("lineitem", "orders", "part"))
    whole = items.join(orders, items.l_orderkey == orders.o_orderkey).join(parts, items.l_partkey == parts.p_partkey)
    assert plain.count() == whole.count() + whole.filter("l_orderkey % 200 = 0").count()
    base = staging.clean_base(numbered, BINDING)
    assert rows_of(base) == rows_of(staging.clean_base(plain, BINDING)) and base.count() < plain.count()
    moves = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan_of(base).partition("== Physical Plan ==")[2])
    assert moves and all(m.startswith("lpad(") for m in moves)


def test_a_line_with_another_number_than_its_invoice_is_refused(spark):
    raw = spark.createDataFrame([tuple(sale("HD00000012.01", "tea").values())], SCHEMA)
    assert staging.clean_base(raw.withColumn(staging.INVOICE_NO, F.lit("00000012")), DEFAULT).count() == 1
    with pytest.raises(Exception, match="does not hold the number"):
        staging.clean_base(raw.withColumn(staging.INVOICE_NO, F.lit("00000013")), DEFAULT).collect()
