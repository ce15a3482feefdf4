"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Texts with equal sets of five-word shingles are one class, with their number of copies.
2. Classes that share a band of MinHash values are candidates. Bands of four values out of
   128 miss a pair at the threshold of 0.8 with probability 5e-8.
3. Candidates compare their MinHash values 16 at a time. After each step a pair is dropped
   when the posterior probability that its similarity reaches the threshold falls below the
   tolerance (1e-6). Survivors are united to groups.
4. Within each group all classes are verified exactly on their shingle sets, in blocks of
   bounded size. Links are counted with their copies where they are found; no pair becomes a
   row. Verified links alone decide the components.

A hot band or group is dealt to pairs of blocks, so that any two of its members meet and no
task holds more than two blocks of them.

Nulls and edge cases: a null or empty text, or one of white space, has no shingles and links
with nothing; a text of one to four words is one shingle of all of them; rows may repeat, ids
too; a null id names a class or component only if no other does; no rows give no rows. Other
columns are not carried by `joined` and pass through `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.functions.shipping import shipped
from shelfcast.functions.tables import written
from shelfcast.llm.common import fresh, table
from shelfcast.llm.components import block_pairs, components
from shelfcast.llm.local_graph import least_labels, stretches
from shelfcast.llm.shingles import WordHashes, band_keys, least_matches, minhashes, overlaps, shingle_set

THRESHOLD = 0.8
TOLERANCE = 1e-6
HASHES = 128
BAND_ROWS = 4
STEP = 16
KEPT_BITS = 8
SEED = 7
# Classes of a band or a group in a block.
BAND_BLOCK = 2048
GROUP_BLOCK = 256
BAND_TASK = 8192
GROUP_TASK = 1024

SKETCHES = pa.schema([("doc_id", pa.int64()), ("row_key", pa.string()), ("set_hash", pa.binary()),
                      ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])
VERIFIED = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def row_key(doc_id: str, text: str) -> Column:
    """Names a row by its id and a hash of its text; equal rows share it."""
    return F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")),
                       F.when(F.col(text).isNull(), F.lit("null")).otherwise(F.xxhash64(text).cast("string")))


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: a digest of its shingle set, the low bits of its MinHash values, its band keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), hashes) for t in batch.column("text")]
            held = [i for i, s in enumerate(sets) if len(s)]
            values = minhashes([sets[i] for i in held], HASHES, SEED)
            low, keys = (values & ((1 << KEPT_BITS) - 1)).astype(np.uint8), band_keys(values, BAND_ROWS)
            digest, kept, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            for at, i in enumerate(held):
                digest[i], kept[i], bands[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), low[at].tobytes(), keys[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("row_key"), pa.array(digest, pa.binary()),
                 pa.array(kept, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=SKETCHES)

    return docs.select("doc_id", "row_key", "text").mapInArrow(
        sketch, "doc_id long, row_key string, set_hash binary, sketch binary, bands array<long>")


def _unite_survivors(group: pa.Table) -> pa.Table:
    """Links that unite the classes of each band whose MinHash values survive the pruning.

    Only pairs that are not united yet are compared: more links would not change the groups.
    """
    steps = [(end, least_matches(end, THRESHOLD, TOLERANCE, KEPT_BITS)) for end in range(STEP, HASHES + 1, STEP)]
    group = group.sort_by("key")
    nodes = group.column("node").to_numpy()
    values = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(nodes), HASHES)
    out: list[tuple[int, int]] = []
    for start, end in stretches(group.column("key").to_numpy()):
        labels = np.arange(start, end)
        for i in range(start, end - 1):
            rest = i + 1 + np.flatnonzero(labels[i + 1 - start:] != labels[i - start])
            equal, done = np.zeros(len(rest), np.int32), 0
            for upto, least in steps:
                if not len(rest):
                    break
                equal += (values[rest, done:upto] == values[i, done:upto]).sum(axis=1)
                keep = equal >= least
                rest, equal, done = rest[keep], equal[keep], upto
            for j in rest.tolist():
                if labels[j - start] != labels[i - start]:
                    labels[labels == labels[j - start]] = labels[i - start]
                    out.append((nodes[i], nodes[j]))
    return pa.Table.from_pydict({"u": [u for u, _ in out], "v": [v for _, v in out]}, schema=EDGES)


def _verify(group: pa.Table) -> pa.Table:
    """Exact links within each group: their number with copies, and the smallest node they lead to."""
    group = group.sort_by("component")
    nodes, copies, block = (group.column(c).to_numpy() for c in ("node", "copies", "block"))
    sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
    within = group.column("block_i").to_numpy() == group.column("block_j").to_numpy()
    links, roots = np.zeros(len(nodes), np.int64), nodes.copy()
    for start, end in stretches(group.column("component").to_numpy()):
        size = np.array([len(s) for s in sets[start:end]])
        shared = overlaps(sets[start:end])
        near = shared >= THRESHOLD * (size[:, None] + size[None, :] - shared) - 1e-9
        np.fill_diagonal(near, False)
        counted = near if within[start] else near & (block[start:end, None] != block[None, start:end])
        links[start:end] = counted @ copies[start:end]
        labels = least_labels(near)
        roots[start:end] = nodes[start:end][labels]
    return pa.Table.from_arrays([pa.array(nodes), pa.array(links), pa.array(roots)], schema=VERIFIED)


def _shingled(texts: DataFrame) -> DataFrame:
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), hashes).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(shingle, "node long, shingles binary")


def _candidates(classes: DataFrame) -> DataFrame:
    """(u, v): links between classes of a band that survive the pruning."""
    banded = classes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("node")).alias("who"))
    # Bands with the same members (a group shares many of its bands) are looked at once.
    kept = buckets.filter("members > 1").groupBy("members", "who").agg(F.min("key").alias("key")).select("key", "members")
    shared = written(banded.join(kept, "key"), "shared-bands")
    dealt = block_pairs(shared, "key", "members", "node", BAND_BLOCK, BAND_TASK)
    sketched = dealt.join(classes.select("node", "sketch"), "node")
    return sketched.groupBy("bucket", "block_i", "block_j").applyInArrow(_unite_survivors, "u long, v long")


def _verified(grouped: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, links, root) of all classes in groups, from their texts."""
    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    members = written(grouped.join(sizes, "component").join(classes.select("node", "copies", "text_row"), "node"), "groups")
    # One row per class; rows that are equal share a row key, and any of them will do.
    wanted = members.select("node", "text_row")
    # The list grows with the corpus, so this is a merge join whatever its size: one way at every size.
    texts = docs.join(wanted.hint("merge"), docs["row_key"] == wanted["text_row"]).select("node", "text")
    # A row key that repeats (equal rows, ids and all) gives a node several times.
    shingles = _shingled(texts).groupBy("node").agg(F.first("shingles").alias("shingles"))
    dealt = block_pairs(members.drop("text_row"), "component", "members", "node", GROUP_BLOCK, GROUP_TASK)
    return dealt.join(shingles, "node").groupBy("bucket", "block_i", "block_j").applyInArrow(
        _verify, "node long, links long, root long")


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, row_key, class_id, n_links, component_id, kept, keeper.

    class_id is the smallest id with an equal shingle set, component_id the smallest id that
    links lead to. n_links counts the other documents linked directly, copies included. `keeper`
    is the row key of the one row that stays for the component.
    """
    shipped(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))
    rows = written(sketches(docs), "sketches")
    held = rows.filter(F.col("set_hash").isNotNull())
    named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")
    classes = written(
        held.groupBy("set_hash").agg(
            F.min(named).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"),
            F.first("bands").alias("bands"))
        .withColumn("text_row", F.col("least.row_key")).withColumn("node", F.monotonically_increasing_id()), "classes")

    groups = written(components(written(_candidates(classes), "survivors")), "candidate-groups")
    verified = written(_verified(groups, classes, docs), "verified")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    united = components(verified.select(F.col("node").alias("u"), F.col("root").alias("v")))
    least = united.join(classes.select("node", "least"), "node")
    leaders = least.groupBy("component").agg(F.min("least").alias("leader"))
    told = united.join(leaders, "component").select("node", "leader")
    result = written(
        classes.select("set_hash", "node", "least", "copies").join(links, "node", "left").join(told, "node", "left")
        .select("set_hash", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("leader", "least").alias("leader")), "class-results")
    linked = held.select("doc_id", "row_key", "set_hash").join(result, "set_hash").select(
        "doc_id", "row_key", F.col("least.doc_id").alias("class_id"), "n_links",
        F.col("leader.doc_id").alias("component_id"), F.col("leader.row_key").alias("keeper"))
    alone = rows.filter(F.col("set_hash").isNull()).select(
        "doc_id", "row_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.col("doc_id").alias("component_id"), F.col("row_key").alias("keeper"))
    return linked.unionByName(alone).withColumn("kept", F.col("row_key") == F.col("keeper"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each component; rows without words all stay, but for equal ones."""
    key, first = fresh(docs, "_row_key"), fresh(docs, "_first")
    kept = written(joined(docs, doc_id, text).filter("kept").select(F.col("row_key").alias(key)).distinct(), "kept")
    rows = docs.withColumn(key, row_key(doc_id, text)).join(kept, key, "left_semi")
    # Rows equal in id and text share the key: one of them stays, pruned ahead of the shuffle.
    one = F.row_number().over(Window.partitionBy(key).orderBy(F.col(doc_id)))
    return rows.withColumn(first, one).filter(F.col(first) == 1).select(*docs.columns)


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT n, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
      FROM d WHERE len(w) > 0),
sizes AS (SELECT n, count(*) AS c FROM s GROUP BY n),
shared AS (SELECT a.n AS a, b.n AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.n <> b.n GROUP BY ALL),
links AS (SELECT p.a, p.b, p.c = x.c AND p.c = y.c AS same FROM shared p JOIN sizes x ON x.n = p.a JOIN sizes y ON y.n = p.b
          WHERE p.c >= 0.8 * (x.c + y.c - p.c)),
reached(n, m) AS (SELECT n, n FROM d UNION SELECT r.n, l.b FROM reached r JOIN links l ON l.a = r.m),
named AS (SELECT r.n, min(d.doc_id) AS component_id FROM reached r JOIN d ON d.n = r.m GROUP BY r.n),
counted AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a),
classes AS (SELECT a AS n, min(d.doc_id) AS least FROM links JOIN d ON d.n = b WHERE same GROUP BY a)
SELECT doc_id, least(doc_id, least) AS class_id, coalesce(n_links, 0) AS n_links, component_id, doc_id = component_id AS kept
FROM d JOIN named USING (n) LEFT JOIN counted USING (n) LEFT JOIN classes USING (n)
"""
