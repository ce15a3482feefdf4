"""Subtree totals of a forest too deep or too wide for one task, by parallel tree contraction.

A round rakes all leaves into their parents, and then compresses unary chains: a node with one
child left, whose hash is smaller than its parent's and its child's, hands its weight to the edge
above that child and leaves. No two neighbours leave in one round, and about a third of each
chain does, so the rounds grow with the logarithm of the number of nodes, whatever the shape.
The rounds are then undone backwards: a compressed node's total is what it held when it left,
plus the total of its child.

A parent of very many children is summed before the shuffle, and no other step has a hot key:
both sides of each join hold a node once. Every round is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfcast.functions.tables import written


def _rank(round_: int, node: str) -> Column:
    return F.xxhash64(F.lit(round_), F.col(node))


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(node, *values): for each node the sums of `values` over the node and all below it.

    `tree` has one row per node: node and parent (long), null for the parent of a root, and the
    `values` (long, null counts as 0). Every parent must be a node, and there must be no circle. No
    nodes give no rows.
    """
    held, edge = {v: f"_held_{v}" for v in values}, {v: f"_edge_{v}" for v in values}
    children = tree.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("left"))
    active = written(tree.join(children, "node", "left").select(
        "node", "parent", F.coalesce("left", F.lit(0)).alias("left"),
        *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(held[v]) for v in values],
        *[F.lit(0).cast("long").alias(edge[v]) for v in values]), "contract-0")
    leaves, gone = [], []
    while True:
        round_ = len(leaves) + 1
        leaves.append(active.filter("left = 0").select("node", *[F.col(held[v]).alias(v) for v in values]))
        if active.filter("left > 0").isEmpty():
            break
        # Rake: what leaves hand up, and which children stay.
        stays = F.col("left") > 0
        up = active.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
            *[F.sum(F.when(~stays, F.col(held[v]) + F.col(edge[v])).otherwise(0)).alias(f"_raked_{v}") for v in values],
            F.count_if(stays).alias("now"), F.max(F.when(stays, F.col("node"))).alias("only"))
        raked = written(active.filter(stays).join(up, "node").select(
            "node", "parent", F.col("now").alias("left"), "only",
            *[(F.col(held[v]) + F.col(f"_raked_{v}")).alias(held[v]) for v in values], *edge.values()), f"rake-{round_}")
        # Compress: a chain node whose hash is the least of its neighbours' gives way to its child.
        leaves_now = (F.col("left") == 1) & F.col("parent").isNotNull() & (
            (_rank(round_, "node") < _rank(round_, "only")) & (_rank(round_, "node") < _rank(round_, "parent")))
        leaves_now = F.coalesce(leaves_now, F.lit(False))
        passed = raked.filter(leaves_now).select(
            F.col("only").alias("node"), F.col("node").alias("removed"), F.col("parent").alias("above"),
            *[F.col(held[v]).alias(f"_was_{v}") for v in values],
            *[(F.col(held[v]) + F.col(edge[v])).alias(f"_pass_{v}") for v in values])
        active = written(raked.filter(~leaves_now).join(passed, "node", "left").select(
            "node", F.coalesce("above", "parent").alias("parent"), "left", *held.values(),
            *[(F.col(edge[v]) + F.coalesce(f"_pass_{v}", F.lit(0))).alias(edge[v]) for v in values],
            "removed", *[(F.col(f"_was_{v}") + F.col(edge[v])).alias(f"_kept_{v}") for v in values]), f"contract-{round_}")
        gone.append(active.filter(F.col("removed").isNotNull()).select(
            "removed", "node", *[F.col(f"_kept_{v}") for v in values]))
    # Back out: the child of a node that left in some round got its total in a later one.
    known = [leaves[-1]]
    for left, removed in zip(leaves[-2::-1], gone[::-1]):
        totals = reduce(DataFrame.unionByName, known)
        back = removed.join(totals, "node").select(
            F.col("removed").alias("node"), *[(F.col(f"_kept_{v}") + F.col(v)).alias(v) for v in values])
        known += [written(back, "expand"), left]
    return reduce(DataFrame.unionByName, known)
