"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

A uniform permutation of all rows is made without ever holding them together:

1. every input partition permutes its rows by a seeded hash of their place as read, so that equal rows
   part like any others, and writes them with their new place;
2. the matrix says how many rows of partition p go to shard s. For a uniform permutation its
   rows are multivariate hypergeometric. It is drawn as a binary tree over the partitions:
   each node splits its shard counts between its two halves, so all nodes of a level are
   drawn at once and every draw is exact, by inversion from the mode;
3. a row's place in its partition, against the running counts of the matrix, is its shard;
4. the rows of a shard are permuted again, and their place is the slot.

The law is `rows`: shard counts differ by one at most, whatever the keys or sizes are.

Nulls and edge cases: any column may be null; a null text has no bytes; repeated rows are
dealt like different ones; fewer rows than shards leave shards empty; no rows give no rows. Columns
of the input named `shard` or `slot` are replaced, all others pass through. Reruns agree where the
input is read in the same partitions and order, as files are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from shelfcast.functions.tables import written
from shelfcast.llm.common import fresh, numbered, partition_of, row_of, table

SHARDS = 24
SEED = "shard"
# Draws further than this many standard deviations from the mode have no mass in a double.
REACH = 9
LEVELS_PER_TABLE = 6


def _let(names: str, body: str) -> str:
    """SQL that binds a struct of values to `v` for `body`, so that they are computed once."""
    return f"transform(array({names}), v -> {body})[0]"


def _draw_one(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the marked rows among `drawn` rows from `total` of which `marked` are marked.

    Weights relative to the mode's are summed upwards and downwards; the walk then stops where
    u times their sum is used up.
    """
    mode = (f"least(least({drawn}, {marked}), greatest(greatest(0L, {drawn} + {marked} - {total}), "
            f"cast(floor(({drawn} + 1D) * ({marked} + 1D) / ({total} + 2D)) AS BIGINT)))")
    spread = (f"cast(ceil({REACH} * sqrt(greatest(0D, cast({drawn} AS DOUBLE) * {marked} / greatest({total}, 1L) "
              f"* (1 - cast({marked} AS DOUBLE) / greatest({total}, 1L)) * ({total} - {drawn}) "
              f"/ greatest({total} - 1, 1L)))) AS BIGINT) + 10")
    # The walks go no further than the values the draw can take.
    top = "least(least(v.drawn, v.marked), v.mode + v.reach)"
    bottom = "greatest(greatest(0L, v.drawn + v.marked - v.total), v.mode - v.reach)"
    none = "cast(array() AS ARRAY<BIGINT>)"
    first = _let(
        f"named_struct('total', {total}, 'marked', {marked}, 'drawn', {drawn}, 'mode', {mode}, 'reach', {spread}, 'u', {u})",
        f"named_struct('total', v.total, 'marked', v.marked, 'drawn', v.drawn, 'mode', v.mode, 'u', v.u, "
        f"'ups', CASE WHEN v.mode < {top} THEN sequence(v.mode + 1, {top}) ELSE {none} END, "
        f"'downs', CASE WHEN v.mode > {bottom} THEN sequence(v.mode - 1, {bottom}) ELSE {none} END)")
    # Weight of k from that of k - 1, and of k from that of k + 1.
    neither = "(v.total - v.marked - v.drawn + k)"
    up = f"a.w * (v.marked - k + 1D) * (v.drawn - k + 1D) / (cast(k AS DOUBLE) * {neither})"
    down = f"a.w * (k + 1D) * ({neither} + 1D) / ((v.marked - cast(k AS DOUBLE)) * (v.drawn - k))"

    def mass(ks: str, ratio: str) -> str:
        return (f"aggregate({ks}, named_struct('w', 1D, 's', 0D), "
                f"(a, k) -> named_struct('w', {ratio}, 's', a.s + {ratio}), a -> a.s)")

    def walk(ks: str, ratio: str, rest: str) -> str:
        step = (f"(a, k) -> CASE WHEN a.k >= 0 THEN a WHEN a.r < {ratio} THEN named_struct('w', a.w, 'r', a.r, 'k', k) "
                f"ELSE named_struct('w', {ratio}, 'r', a.r - {ratio}, 'k', -1L) END")
        return f"aggregate({ks}, named_struct('w', 1D, 'r', {rest}, 'k', -1L), {step})"

    summed = f"transform(array({first}), v -> named_struct('v', v, 't', v.u * (1D + {mass('v.ups', up)} + {mass('v.downs', down)})))[0]"
    rise = walk("x.v.ups", up.replace("v.", "x.v."), "x.t - 1D")
    fall = walk("x.v.downs", down.replace("v.", "x.v."), "y.r")
    return (f"transform(array({summed}), x -> CASE WHEN x.t < 1D THEN x.v.mode ELSE transform(array({rise}), y -> "
            f"CASE WHEN y.k >= 0 THEN y.k ELSE greatest({fall}.k, -1L) END)[0] END)[0]")


def _uniform(seed: str, *parts: str) -> str:
    return f"(shiftrightunsigned(xxhash64('{seed}', {', '.join(parts)}), 11) / 9007199254740992D)"


def _draw_row(caps: str, drawn: str, node: str, shards: int, seed: str) -> str:
    """SQL for one multivariate draw: how many of `drawn` rows go to each shard."""
    one = _draw_one("s.pop", f"{caps}[i]", "s.rest", _uniform(seed, node, "i"))
    bound = f"transform(array({one}), c -> CASE WHEN c < 0 THEN greatest(0L, s.rest + {caps}[i] - s.pop) ELSE c END)[0]"
    return (f"aggregate(sequence(0, {shards - 1}), named_struct('pop', aggregate({caps}, 0L, (p, c) -> p + c), "
            f"'rest', {drawn}, 'out', cast(array() AS ARRAY<BIGINT>)), "
            f"(s, i) -> transform(array({bound}), c -> named_struct('pop', s.pop - {caps}[i], 'rest', s.rest - c, "
            f"'out', concat(s.out, array(c))))[0], s -> s.out)")


def communication_matrix(sizes: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(part, counts): how many rows of each partition go to each shard.

    `sizes` has one row (part, n) per input partition. The root holds one pair of numbers per
    partition, as the scheduler does; the tree spreads after a few levels.
    """
    parts = sizes.count()
    root = sizes.agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts"), F.sum("n").alias("total"))
    nodes = root.filter("total > 0").select("parts", F.lit(1).cast("long").alias("node"), F.expr(
        f"transform(sequence(0, {shards - 1}), s -> total div {shards} + IF(s < total % {shards}, 1L, 0L))").alias("caps"))
    for level in range(math.ceil(math.log2(parts)) if parts > 1 else 0):
        if level and level % LEVELS_PER_TABLE == 0:
            nodes = written(nodes.repartition("node"), "matrix-level")
        halves = nodes.selectExpr(
            "caps", "node", "parts", "slice(parts, 1, size(parts) div 2) AS l",
            "slice(parts, size(parts) div 2 + 1, size(parts)) AS r")
        drawn = halves.selectExpr("caps", "node", "parts", "l", "r", "CASE WHEN size(l) > 0 THEN " + _draw_row(
            "caps", "aggregate(l, 0L, (a, p) -> a + p.n)", "node", shards, seed) + " END AS c")
        nodes = drawn.selectExpr(
            "explode(CASE WHEN c IS NULL THEN array(named_struct('parts', parts, 'node', node * 2, 'caps', caps)) ELSE "
            "array(named_struct('parts', l, 'node', node * 2, 'caps', c), named_struct('parts', r, 'node', node * 2 + 1, "
            "'caps', zip_with(caps, c, (a, b) -> a - b))) END) AS x").select("x.*")
    return nodes.selectExpr("parts[0].part AS part", "caps AS counts")


def sharded(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """`docs` with `shard` (0 to shards - 1) and `slot` (0-based place within the shard)."""
    docs = docs.drop("shard", "slot")
    place, bounds, read = fresh(docs, "_place"), fresh(docs, "_bounds"), fresh(docs, "_read")
    permuted = written(
        docs.withColumn(read, F.monotonically_increasing_id()).sortWithinPartitions(F.xxhash64(F.lit(seed), read), read)
        .drop(read).withColumn(place, F.monotonically_increasing_id()), "permuted")
    sizes = written(
        permuted.groupBy(partition_of(F.col(place)).alias("part")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    running = F.expr("transform(sequence(1, size(counts)), s -> aggregate(slice(counts, 1, s), 0L, (a, c) -> a + c))")
    matrix = written(
        communication_matrix(sizes, shards, seed).select(F.col("part").alias(place + "m"), running.alias(bounds)), "matrix")
    dealt = permuted.join(matrix, partition_of(F.col(place)) == F.col(place + "m")).withColumn(
        bounds, F.size(F.filter(F.col(bounds), lambda b: b <= row_of(F.col(place))))).drop(place + "m")
    again = F.xxhash64(F.lit(seed + "-again"), F.col(place))
    slots = numbered(dealt.withColumnRenamed(bounds, "shard"), "shard", [again, F.col(place)], "slot", "sharded")
    return slots.select(*docs.columns, "shard", "slot")


def op4_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32("text").alias("text_crc32"))
    return sharded(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"))
