"""Connected components of a graph too large for one task, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfcast.functions.tables import written


def _stamp(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge; `component` is its smallest node.

    `edges` has columns u, v of one orderable type without nulls. Each round points every node's
    larger neighbours, then its smaller ones, at the smallest node it knows; the rounds grow
    with the logarithm of a component's size. A hub's minimum is taken before the shuffle. The
    hub is then a hot key of a join: the minima are written, so that both sides of the join come
    straight from a shuffle and adaptive execution can split it. Each round is written.
    """
    pairs = written(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    before, now = None, _stamp(pairs)
    while now != before:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        down = written(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        moved = large.join(down, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(moved.unionByName(down.withColumnRenamed("m", "v")).distinct(), "star")
        before, now = now, _stamp(pairs)
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def block_pairs(members: DataFrame, key: str, size: str, node: str, most: int, per_task: int) -> DataFrame:
    """Deal groups to tasks of bounded size, so that any two members of a group meet once.

    A group of up to `most` members is packed with others into a bucket of about `per_task`
    rows (block_i = block_j = -1). A larger one is split into blocks by a hash of `node`, and
    each row goes to every pair of blocks its own is part of: members meet in blocks, and no
    pair becomes a row. Adds bucket, block_i, block_j and block (the row's own).
    """
    packs = max(1, members.filter(F.col(size) <= most).count() // per_task)
    blocks = F.ceil(F.col(size) / most).cast("int")
    own = members.withColumn("block", F.when(F.col(size) > most, F.pmod(F.xxhash64(node), blocks).cast("int")).otherwise(-1))
    other = F.when(F.col("block") >= 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(-1)))
    return own.withColumn("other", F.explode(other)).select(
        *members.columns, "block", F.least("block", "other").alias("block_i"), F.greatest("block", "other").alias("block_j"),
        F.when(F.col("block") >= 0, F.col(key)).otherwise(F.pmod(F.xxhash64(key), F.lit(packs))).alias("bucket"))
