"""The helpers that keep hot keys and global orders off a single task, against brute force."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelfcast.functions.joins import left_join_where
from shelfcast.functions.medians import banded_median, banded_quantiles, median
from shelfcast.functions.running import median_before
from shelfcast.functions.scans import ordered_running
from shelfcast.operators import basket
from shelfcast.operators.staging import dedup_latest


@pytest.mark.parametrize("hot_rows", [1_000_000, 40, 5])
def test_median_before_equals_brute_force_with_a_hot_key(spark, hot_rows):
    rng = random.Random(1)
    start = datetime(2026, 1, 1)
    rows = [(("hot" if rng.random() < 0.4 else rng.choice([None, "k1", "k2", "k3"])), start + timedelta(minutes=37 * rng.randrange(400)),
             i, rng.choice([None, 1.0, 2.0, 5.0, 9.0, 2.5])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t timestamp, i int, v double")
    got = {r["i"]: r["m"] for r in median_before(
        df, "k", "t", [F.col("t"), F.col("i")], "v", "m", hot_rows).collect()}
    seen: dict = {}
    for k, _, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        past = seen.setdefault(k, [])
        assert got[i] == (statistics.median(past) if past else None)
        if v is not None:
            past.append(v)
    assert len(got) == 600


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-50, 50)), min_size=1, max_size=60))
def test_banded_median_equals_median(spark, pairs):
    df = spark.createDataFrame([(k, v / 4) for k, v in pairs], "k string, v double")
    banded = {r["k"]: r["m"] for r in banded_median(df, ["k"], "v", "m").collect()}
    plain = {r["k"]: r["m"] for r in df.groupBy("k").agg(median("v").alias("m")).collect()}
    assert banded == plain


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", None]), st.integers(-20, 20)), min_size=1, max_size=80))
def test_banded_quantiles_equal_percentiles(spark, pairs):
    taus = [0.0, 0.1, 0.5, 0.55, 0.9, 1.0]
    df = spark.createDataFrame([(k, v / 4) for k, v in pairs], "k string, v double")
    banded = {r["k"]: r["q"] for r in banded_quantiles(df, ["k"], "v", taus, "q").collect()}
    plain = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(t) for t in taus])).alias("q")).collect()}
    assert set(banded) == set(plain) and all(banded[k] == pytest.approx(plain[k]) for k in plain)


def test_banded_median_on_many_distinct_values(spark):
    df = spark.range(0, 200_001).select(F.lit("x").alias("k"), (F.col("id") * 7919 % 200_001).cast("double").alias("v"))
    assert banded_median(df, ["k"], "v", "m").first()["m"] == 100_000.0


def test_ordered_running_equals_one_global_window(spark):
    rng = random.Random(2)
    rows = [(f"s{i:04d}", float(rng.choice([1, 1, 1, 2, 3, 50]))) for i in range(500)]
    df = spark.createDataFrame(rows, "s string, q double").repartition(7)
    got = {r["s"]: (r["rk"], r["total"]) for r in ordered_running(
        df, [F.col("q").desc(), F.col("s").asc()], {"total": "q"}, rank="rk").collect()}
    running = 0.0
    for place, (s, q) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), start=1):
        running += q
        assert got[s] == (place, running)


def test_left_join_where_keeps_every_row(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    right = spark.createDataFrame([("a", 10), ("b", 20)], "k string, v int")
    got = {r["id"]: r["v"] for r in left_join_where(left, F.col("id") > 1, [(right, ["k"])]).collect()}
    assert got == {1: None, 2: 20, 3: None}


def test_dedup_prunes_copies_before_the_shuffle(spark):
    cols = "invoice_id string, sold_at timestamp, sku string, loaded_at timestamp, source_hash string, " \
           "unit_price double, quantity double, unit_cost double"
    day = datetime(2026, 1, 1)
    rows = [("i", day, "s", day + timedelta(seconds=n), "h", 1.0, float(n), 1.0) for n in range(200)]
    df = dedup_latest(spark.createDataFrame(rows, cols))
    assert [r["quantity"] for r in df.collect()] == [199.0]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_block_counts_equal_pair_counting(spark):
    rng = random.Random(3)
    sets = [sorted(rng.sample(range(9), rng.randrange(1, 6))) for _ in range(300)]
    df = spark.createDataFrame([(s,) for s in sets], "codes array<int>").repartition(5)
    got = {(r["first"], r["second"]): r["n"] for r in df.mapInPandas(
        basket._block_counts, "first bigint, second bigint, n bigint").groupBy("first", "second").agg(
        F.sum("n").alias("n")).collect()}
    want: dict = {}
    for s in sets:
        for i, a in enumerate(s):
            for b in s[i + 1:]:
                want[a, b] = want.get((a, b), 0) + 1
    assert got == want


def test_bands_leave_the_rows_in_place(spark):
    rows = spark.range(3000).selectExpr("CAST(id % 3 AS STRING) AS k", "CAST(id AS DOUBLE) AS v")
    plan = banded_median(rows, ["k"], "v", "m")._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
