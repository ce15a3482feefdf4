"""Sharding: exact sizes, whole rows, and the distribution of the matrix."""

from collections import Counter
from math import comb

from pyspark.sql import functions as F

from shelfcast.llm import sharding
from shelfcast.llm.sharding import communication_matrix, sharded


def test_every_row_gets_one_slot_of_a_shard_of_exact_size(spark, awkward, empty):
    got = sharded(awkward, shards=7)
    rows = got.collect()
    assert len(rows) == awkward.count()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(len(s) for s in slots.values()) == sorted(len(rows) // 7 + (i < len(rows) % 7) for i in range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    kept = [c for c in awkward.columns if c not in ("shard", "slot")]
    assert got.columns == [*kept, "shard", "slot"]
    assert sorted(map(str, got.select(kept).collect())) == sorted(map(str, awkward.select(kept).collect()))
    assert sharded(empty).count() == 0
    few = sharded(awkward.limit(3), shards=24)
    assert [r["slot"] for r in few.collect()] == [0, 0, 0]


def test_reruns_agree_and_seeds_differ(spark, awkward):
    places = lambda seed: sorted(map(str, sharded(awkward, seed=seed).collect()))
    assert places("a") == places("a") != places("b")


def test_matrix_has_the_margins(spark):
    sizes = [1000, 3, 0, 500, 777, 10, 1, 25000]
    df = spark.createDataFrame(list(enumerate(sizes)), "part long, n long")
    matrix = {r["part"]: r["counts"] for r in communication_matrix(df).collect()}
    assert {p: sum(c) for p, c in matrix.items()} == dict(enumerate(sizes))
    shards = [sum(c) for c in zip(*matrix.values())]
    assert max(shards) - min(shards) <= 1 and sum(shards) == sum(sizes)


def test_one_draw_is_hypergeometric(spark):
    draws = 60000
    column = sharding._draw_one("100L", "30L", "40L", sharding._uniform("t", "id"))
    seen = Counter({r["k"]: r["count"] for r in spark.range(draws).select(F.expr(column).alias("k")).groupBy("k").count().collect()})
    chi = terms = 0
    for k in range(31):
        expected = comb(30, k) * comb(70, 40 - k) / comb(100, 40) * draws
        if expected > 5:
            chi, terms = chi + (seen[k] - expected) ** 2 / expected, terms + 1
    assert chi < 3 * terms


def test_rows_of_a_partition_spread_evenly(spark):
    rows = sharded(spark.range(4800, numPartitions=6).withColumn("part", F.spark_partition_id()), shards=4).collect()
    counts = Counter((r["part"], r["shard"]) for r in rows)
    assert len(counts) == 24 and all(130 < n < 270 for n in counts.values())


def test_copies_of_a_row_part_like_different_rows(spark):
    copies = spark.createDataFrame([(i, f"t{i}") for i in range(3000) for _ in range(3)], "doc_id long, text string").coalesce(2)
    held = Counter(len(r["s"]) for r in sharded(copies).groupBy("doc_id").agg(F.collect_set("shard").alias("s")).collect())
    # Three of one shard: 1 in 576; of three shards: 23 * 22 in 576.
    expected = {1: 3000 / 576, 2: 3000 * 69 / 576, 3: 3000 * 506 / 576}
    assert sum((held[k] - e) ** 2 / e for k, e in expected.items()) < 16
