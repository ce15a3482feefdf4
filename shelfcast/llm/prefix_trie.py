"""The prefix trie of conversations, with subtree totals by parallel tree contraction.

1. Turns are numbered within their conversation over a range partitioning, so that a conversation
   may be longer than a task. A turn is the digest of role and text; texts are read once.
2. A prefix is named by its length and the exclusive or of the hashes of (place, turn) so far, 128
   bits, a running value that spreads over slices like a running sum. Equal prefixes are a node.
3. Nodes are linked to their parents; a node with very many children is a hot key of that join
   only, whose sides come straight from a shuffle, so that adaptive execution splits it.
4. Leaf counts and saved tokens are summed over subtrees by `contraction.subtree_totals`: rounds
   that rake leaves and compress unary chains, then undone backwards.
5. The digest of the conversations that end at a node is streamed: ids are joined to strings by
   stretches of 4,096 ids, sorted, and hashed in that order without holding a node's list.

Nulls and edge cases: a null role or text is empty; a null turn comes first; turns of one number
are ordered by the digest of role and text; repeated rows are turns of their own; rows without a
conv_id belong to no conversation and are left out; an empty table gives no rows, not even a
root. Texts of any length are one digest. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.functions.tables import written
from shelfcast.llm.common import numbered, table
from shelfcast.llm.contraction import subtree_totals

# Rebuilding takes fewer turns than SPAN from the first conversation of each FAMILY of ids.
FAMILY, SPAN = 5, 9
# Ids of one stretch differ in their lowest bits only, so a stretch has at most 4,096.
STRETCH_BITS = 12
PATH = ["depth", "p1", "p2"]


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv_id, place, digest, bytes): the turns of each conversation, places from 0; written."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    turns = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.md5(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said)).alias("digest"),
        F.octet_length(said).cast("long").alias("bytes"))
    placed = numbered(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], "place", "turns")
    return written(placed.select("conv_id", "place", "digest", "bytes"), "ordered-turns")


def _taken(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(SPAN))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where each conversation begins with turns of its family's first.

    Conversation c takes the first h = crc32(c) % 9 turns of c - c % 5, then its own after its first h.
    """
    h = _taken(F.col("conv_id"))
    sizes = written(turns.groupBy("conv_id").agg((F.max("place") + 1).alias("n")), "conversations")
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < SPAN - 1))
    # Near the ends of the range of ids a family has no further members.
    heirs = F.explode(F.sequence(F.lit(1 - FAMILY), F.lit(FAMILY - 1)))
    taken = (
        heads.withColumn("by", heirs).withColumn("heir", F.try_add("conv_id", F.col("by").cast("long")))
        .filter(F.col("heir") - F.col("heir") % FAMILY == F.col("conv_id")).filter(F.col("place") < _taken(F.col("heir")))
        .join(sizes.select(F.col("conv_id").alias("heir")), "heir", "left_semi")
        .select(F.col("heir").alias("conv_id"), "place", "digest", "bytes"))
    # Only a first conversation of fewer turns than could be taken moves the place of later ones.
    short = sizes.filter((F.col("conv_id") % FAMILY == 0) & (F.col("n") < SPAN - 1)).select(F.col("conv_id").alias("head"), F.col("n").alias("has"))
    absent = sizes.select(first.alias("head")).distinct().join(
        sizes.select(F.col("conv_id").alias("head")), "head", "left_anti").select("head", F.lit(0).cast("long").alias("has"))
    known = written(short.unionByName(absent), "short-heads")
    own = turns.filter(F.col("place") >= h).withColumn("head", first).join(known, "head", "left").select(
        "conv_id", (F.col("place") - h + F.least(h, F.coalesce("has", h))).alias("place"), "digest", "bytes")
    return taken.unionByName(own), sizes.select("conv_id")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, bytes): every prefix of every conversation, and the one before it."""
    hashes = [F.xxhash64(F.lit(f"path-{i}"), "place", "digest").alias(f"a{i}") for i in (1, 2)]
    sliced = written(
        turns.select("conv_id", "place", "bytes", *hashes).repartitionByRange("conv_id", "place")
        .withColumn("slice", F.spark_partition_id()), "slices")
    sums = sliced.groupBy("conv_id", "slice").agg(F.bit_xor("a1").alias("s1"), F.bit_xor("a2").alias("s2"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations cut by a slice's edge: fewer rows than slices.
    carried = written(
        sums.select("conv_id", "slice", F.bit_xor("s1").over(earlier).alias("s1"), F.bit_xor("s2").over(earlier).alias("s2"))
        .filter(F.col("s1").isNotNull()), "carried")
    so_far = Window.partitionBy("conv_id", "slice").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("r1", F.bit_xor("a1").over(so_far)).withColumn("r2", F.bit_xor("a2").over(so_far))
    whole = local.join(carried, ["conv_id", "slice"], "left")
    p1, p2 = (F.col(f"r{i}").bitwiseXOR(F.coalesce(f"s{i}", F.lit(0))) for i in (1, 2))
    return written(whole.select(
        "conv_id", (F.col("place") + 1).alias("depth"), p1.alias("p1"), p2.alias("p2"),
        p1.bitwiseXOR(F.col("a1")).alias("q1"), p2.bitwiseXOR(F.col("a2")).alias("q2"), "bytes"), "prefixes")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per run of rows of equal path, joined by commas, holding no more than a batch."""
    key, digest, done = None, None, []

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*done))
        return pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*PATH, "ends_sha256"])

    for batch in batches:
        for *path, ids in zip(*(batch.column(c).to_pylist() for c in (*PATH, "ids"))):
            if path != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = path, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield flushed()
            done = []
    if key is not None:
        done.append((*key, digest.hexdigest()))
        yield flushed()


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of (conv_id, depth, p1, p2), one row per conversation."""
    stretches = ends.groupBy(*PATH, F.shiftright("conv_id", STRETCH_BITS).alias("stretch")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return stretches.repartition(*PATH).sortWithinPartitions(*PATH, "stretch").mapInArrow(
        _hashed, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of `turns` (conv_id, place, digest, bytes); see the columns.

    `conversations` (conv_id) lists the members of the root, those without turns included. conv_id is
    the smallest member, so a node's last text is turn `depth` of that conversation; the parent's
    likewise. n_convs counts members, n_children children, n_leaves the childless nodes of the
    subtree; saved_tokens is its sum of (n_convs - 1) * bytes of the last text.
    """
    paths = prefixes(turns)
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    nodes = written(
        paths.groupBy(*PATH, "q1", "q2", "bytes").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
        .unionByName(root.select(*[zero.alias(c) for c in (*PATH, "q1", "q2", "bytes")], "conv_id", "n_convs"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                         F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = written(nodes.join(above, ["depth", "q1", "q2"], "left"), "linked")
    children = linked.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = written(linked.join(children, "node", "left").select(
        "node", "parent", "parent_conv_id", "conv_id", *PATH, "n_convs", F.coalesce("n_children", zero).alias("n_children"), "bytes"), "counted")
    totals = subtree_totals(counted.select(
        "node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    last = paths.groupBy("conv_id").agg(
        F.max("depth").alias("depth"), F.max_by("p1", "depth").alias("p1"), F.max_by("p2", "depth").alias("p2"))
    ends = conversations.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in PATH])
    return counted.join(end_digests(ends), PATH, "left").join(totals, "node").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op11_contracted_trie(spark, sf_dir: str) -> DataFrame:
    turns, conversations = rebuilt(ordered_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie(turns, conversations)


# crc32 a bit at a time: there is no such function in DuckDB.
_CRC = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(conv_id::VARCHAR) + 1), "
        "lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), "
        "lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))")
ORACLE = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS k,
         octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') AS said, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
parts AS (
  SELECT c.conv_id, 0 AS part, t.k, t.said, t.bytes FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.k < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.k, t.said, t.bytes FROM c JOIN t ON t.conv_id = c.conv_id AND t.k >= c.h),
r AS (
  SELECT conv_id, row_number() OVER w AS depth, bytes, md5(string_agg(octet_length(encode(said)) || ':' || said, '' ORDER BY part, k) OVER w) AS path
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, 0, md5('') FROM c),
node_of AS (SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(bytes) AS bytes, count(*) AS n_convs FROM r GROUP BY path),
member AS (SELECT r.conv_id, r.depth, n.path, n.conv_id AS rep, n.n_convs, n.bytes FROM r JOIN node_of n USING (path)),
linked AS (
  SELECT n.path, n.conv_id, n.depth, n.n_convs, n.bytes, p.rep AS parent_conv_id, p.path AS parent
  FROM node_of n LEFT JOIN member p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT parent AS path, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY ALL),
valued AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids USING (path)),
totals AS (
  SELECT m.path, sum((v.n_children = 0)::BIGINT) AS n_leaves, sum((v.n_convs - 1) * v.bytes) AS saved
  FROM valued v JOIN member m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY m.path),
ends AS (
  SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS digest
  FROM (SELECT * FROM r QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY path)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM valued JOIN totals USING (path) LEFT JOIN ends USING (path)
"""
