from collections import Counter

from pyspark.sql import functions as F

from shelfcast.functions.sampling import bottom_k


def test_the_sample_does_not_depend_on_the_partitions(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("g"))
    picked = lambda frame: sorted(r["id"] for r in bottom_k(frame, 100, ["id"]).collect())
    one = picked(df.repartition(7))
    assert one == picked(df.coalesce(1)) and len(set(one)) == 100
    merged = bottom_k(df.filter("id < 2000"), 100, ["id"]).unionByName(bottom_k(df.filter("id >= 2000"), 100, ["id"]))
    assert picked(merged) == one
    assert one != sorted(r["id"] for r in bottom_k(df, 100, ["id"], seed="other").collect())


def test_every_row_is_as_likely(spark):
    df = spark.range(60)
    seen = Counter(r["id"] for s in range(100) for r in bottom_k(df, 15, ["id"], seed=str(s)).collect())
    assert sum((seen[i] - 25) ** 2 / (25 * 0.75) for i in range(60)) < 100


def test_few_rows_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, 1)], "id long, v int")
    assert bottom_k(df, 10, ["id"]).count() == 3 and bottom_k(df, 2, ["id"]).count() == 2
    assert bottom_k(df.limit(0), 2, ["id"]).count() == 0
