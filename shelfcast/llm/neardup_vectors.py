"""Near-duplicate embeddings by sorted projection passes.

Equal vectors are one class. In each pass the classes are ordered lexicographically by the
signs of random projections around their mean (per vector length), and each meets at least its
`WINDOW` predecessors, in double precision. Links across all passes are united to components.
The window bounds the partners a pass sees, so the exact way for the rest follows: within a
component all classes are compared, in blocks of bounded size, and counted with their copies;
no pair becomes a row.

The number of passes follows from the table. A pass finds a pair if its signs agree until the
earlier one is in the block: a vector that shares d signs with the first of its block needs d + 1
of them, and two of the least cosine agree in each with a probability that depends on how close
the mean is (0.86 if there is no common direction). `PASSES` are made and measured so on the
vectors they linked with nothing; as many more follow as bring the mean chance to miss a pair
of the least cosine below `MISS`, whatever the size of the table; there is no other way to find
pairs. What the passes miss is what no pass and no chain of links brings together; a vector whose only
link is to a member of a group much larger than the window is not part of the estimate.

Nulls and edge cases: a vector that is null, empty, zero, or holds a null or non-finite
component links with nothing; vectors of different lengths never link; repeated rows are
separate vectors, which link; a null vec_id is never the name of a component if another is at
hand; no rows give no rows. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfcast.functions.shipping import shipped
from shelfcast.functions.tables import written
from shelfcast.llm.common import numbered, table
from shelfcast.llm.components import block_pairs, components
from shelfcast.llm.local_graph import least_labels, matrices, stretches

COSINE = 0.9
# Least number of passes, and how many are made at a time.
PASSES = 32
# Mean chance to miss a pair of the least cosine, and how many lone vectors it is measured on, about.
MISS = 1e-4
PROBES = 20000
BITS = 48
WINDOW = 128
BLOCK = 512
SEED = 20

KEYS = pa.schema([("pass", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("node", pa.int64())])
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("log_miss", pa.float64())])
SUMS = pa.schema([("size", pa.int32()), ("sums", pa.list_(pa.float64()))])
LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64())])


def _cosines(vectors: np.ndarray) -> np.ndarray:
    """Cosines of all rows; the largest component is scaled to 1 first, so squares stay finite."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    lengths = np.sqrt((scaled * scaled).sum(axis=1))
    return scaled @ scaled.T / (lengths[:, None] * lengths[None, :])


def _directions(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def mean_directions(classes: DataFrame) -> dict[int, np.ndarray]:
    """The mean of all directions for each length of vector."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, vectors in matrices(batch.column("embedding")):
                size = vectors.shape[1]
                totals[size] = totals.get(size, 0) + np.append(_directions(vectors).sum(axis=0), len(vectors))
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))], schema=SUMS)

    # The last sum is the number of vectors.
    parts = classes.select("embedding").mapInArrow(sums, "size int, sums array<double>")
    summed = parts.select("size", F.posexplode("sums").alias("at", "part")).groupBy("size", "at").agg(F.sum("part").alias("total"))
    means: dict[int, np.ndarray] = {}
    for size, at, total in summed.collect():
        means.setdefault(size, np.zeros(size + 1))[at] = total
    return {size: total[:-1] / total[-1] for size, total in means.items()}


def agreement(directions: np.ndarray, mean: np.ndarray, cosine: float) -> np.ndarray:
    """For each direction, how probable it is that a partner of that cosine, as far from the mean, has the same sign.

    A direction so near to the mean that no such partner is as far has one that lies aside: half the signs, at least.
    """
    spread = 1 - 2 * (directions @ mean) + mean @ mean
    inner = np.clip(1 - (1 - cosine) / np.maximum(spread, 1e-12), 0, 1)
    return 1 - np.arccos(inner) / np.pi


def passes_needed(log_misses: np.ndarray, done: int, miss: float = MISS) -> int:
    """The least number of passes with a mean chance of at most `miss`; each value is the log of a vector's chance after `done`."""
    enough = lambda n: np.exp(log_misses * (n / done)).mean() <= miss
    if not len(log_misses) or enough(done):
        return done
    low, high = done, 2 * done
    while not enough(high) and high < 1 << 40:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def pass_keys(classes: DataFrame, passes: range, bits: int, seed: int, means: dict[int, np.ndarray]) -> DataFrame:
    """(pass, size, hash, node): the concatenated projection signs of every class in every pass."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for rows, vectors in matrices(batch.column("embedding")):
                centred = _directions(vectors) - means[vectors.shape[1]]
                for p in passes:
                    planes = np.random.default_rng([seed, vectors.shape[1], p]).standard_normal((vectors.shape[1], bits))
                    signs = (centred @ planes > 0) @ weights
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(rows), p), pa.int32()), pa.array(np.full(len(rows), vectors.shape[1]), pa.int32()),
                        pa.array(signs), pa.array(nodes[rows])], schema=KEYS)

    return classes.select("node", "embedding").mapInArrow(keys, "pass int, size int, hash long, node long")


def _linked(group: pa.Table, cosine: float) -> pa.Table:
    nodes = group.column("node").to_numpy()
    out: list[tuple[int, int]] = []
    for rows, vectors in matrices(group.column("embedding")):
        labels = least_labels(_cosines(vectors) >= cosine)
        at = np.flatnonzero(labels != np.arange(len(rows)))
        out += zip(nodes[rows[at]].tolist(), nodes[rows[labels[at]]].tolist())
    return pa.Table.from_pydict({"u": [u for u, _ in out], "v": [v for _, v in out], "log_miss": [None] * len(out)}, schema=EDGES)


def _missed(group: pa.Table, cosine: float, bits: int, means: dict[int, np.ndarray]) -> pa.Table:
    """(u, null, log_miss) for the probes of a block: the log of the chance that a pass misses a pair of the least cosine."""
    group = group.sort_by("place")
    nodes, sizes, signs, probes = (group.column(c).to_numpy() for c in ("node", "size", "hash", "probe"))
    own = group.column("place").to_numpy() // group.column("length")[0].as_py() == group.column("block")[0].as_py()
    needed = np.zeros(len(nodes))
    if group.column("block")[0].as_py() > 0:
        # Signs shared with the first row, and one more; frexp gives the length of a number in bits.
        shared = bits - np.frexp((signs ^ signs[0]).astype(float))[1]
        needed = np.where(sizes == sizes[0], np.minimum(shared + 1, bits), 0)
    log_miss = np.zeros(len(nodes))
    for rows, vectors in matrices(group.column("embedding")):
        same = agreement(_directions(vectors), means[vectors.shape[1]], cosine)
        log_miss[rows] = np.log1p(-np.minimum(same ** needed[rows], 1 - 1e-12))
    at = np.flatnonzero(own & probes)
    return pa.Table.from_arrays([pa.array(nodes[at]), pa.nulls(len(at), pa.int64()), pa.array(log_miss[at])], schema=EDGES)


def _block_edges(cosine: float, bits: int, means: dict[int, np.ndarray]):
    def edges(group: pa.Table) -> pa.Table:
        return pa.concat_tables([_linked(group, cosine), _missed(group, cosine, bits, means)])

    return edges


def _block_links(cosine: float):
    def links(group: pa.Table) -> pa.Table:
        group = group.sort_by("component")
        nodes, copies, block = (group.column(c).to_numpy() for c in ("node", "copies", "block"))
        totals = np.zeros(len(nodes), np.int64)
        for start, end in stretches(group.column("component").to_numpy()):
            for rows, vectors in matrices(group.column("embedding").slice(start, end - start)):
                rows = rows + start
                near = _cosines(vectors) >= cosine
                np.fill_diagonal(near, False)
                if group.column("block_i")[start] != group.column("block_j")[start]:
                    near &= block[rows][:, None] != block[rows][None, :]
                totals[rows] += near @ copies[rows]
        return pa.Table.from_arrays([pa.array(nodes), pa.array(totals)], schema=LINKS)

    return links


def usable(vector: str = "embedding"):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE,
                    passes: int = PASSES, window: int = WINDOW, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    shipped(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    good = rows.filter(usable())
    classes = written(
        good.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()), "vector-classes")

    order = [F.col("size"), F.col("hash"), F.col("node")]
    # Each block starts with the last `window` classes of the one before it.
    own = F.floor(F.col("place") / block)
    blocks = F.when(F.col("place") % block >= block - window, F.array(own, own + 1)).otherwise(F.array(own))
    means, count = mean_directions(classes), classes.count()
    probe = F.pmod(F.xxhash64("node"), F.lit(max(1, count // PROBES))) == 0

    def passed(numbers: range) -> DataFrame:
        placed = numbered(pass_keys(classes, numbers, BITS, seed, means), "pass", order, "place", "passes")
        met = placed.select("*", F.explode(blocks).alias("block"), probe.alias("probe"), F.lit(block).alias("length"))
        found = met.join(classes.select("node", "embedding"), "node").groupBy("pass", "block").applyInArrow(
            _block_edges(cosine, BITS, means), "u long, v long, log_miss double")
        return written(found, "vector-edges")

    tried = passed(range(passes))
    found = tried.filter("v IS NOT NULL").select("u", "v")
    linked_ones = written(found.select(F.explode(F.array("u", "v")).alias("u")).distinct(), "vector-linked")
    lone = tried.filter("v IS NULL").groupBy("u").agg(F.sum("log_miss").alias("log_miss")).join(linked_ones, "u", "left_anti")
    total = passes_needed(np.array([r["log_miss"] for r in lone.select("log_miss").collect()]), passes)
    for start in range(passes, total, passes):
        more = passed(range(start, min(start + passes, total)))
        found = found.unionByName(more.filter("v IS NOT NULL").select("u", "v"))
    united = written(components(found), "vector-components")

    sizes = united.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    members = written(united.join(sizes, "component"), "vector-members")
    dealt = block_pairs(members, "component", "members", "node", most=2 * block, per_task=4 * block)
    counted = dealt.join(classes.select("node", "embedding", "copies"), "node").groupBy("bucket", "block_i", "block_j")
    links = counted.applyInArrow(_block_links(cosine), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    named = united.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    linked = united.join(named, "component").join(links, "node").select("node", "component_id", "links")
    result = written(
        classes.select("node", "embedding", "first", "copies").join(linked, "node", "left")
        .select("embedding", F.coalesce("component_id", "first").alias("component_id"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-result")

    bad = rows.filter(~usable()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = good.join(result, "embedding").select("vec_id", "n_links", "component_id").unionByName(bad)
    return joined.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_sorted_projections(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, row_number() OVER () AS n, embedding::DOUBLE[] AS e,
         embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
           AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) AS good
  FROM embeddings),
links AS (
  SELECT a.n AS a, b.n AS b, b.vec_id AS id FROM v a JOIN v b ON a.n <> b.n AND a.good AND b.good AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reached(n, m) AS (SELECT n, n FROM v UNION SELECT r.n, l.b FROM reached r JOIN links l ON l.a = r.m),
named AS (SELECT r.n, min(v.vec_id) AS component_id FROM reached r JOIN v ON v.n = r.m GROUP BY r.n),
counted AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN named USING (n) LEFT JOIN counted USING (n)
"""
