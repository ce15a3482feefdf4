"""Benchmark decontamination by fingerprints of item-sized windows.

1. Texts and items become words (lower case, letters and digits) and their five-word shingles.
   Where a document shares shingles with items, every window of an item's size, at whatever start,
   is looked at that holds as many of them as the least similarity takes. Other windows are less
   similar to every item and need no fingerprint. Seeds are repeated under a few salts, so that a
   passage that many documents hold is not one hot key.
2. Each window and item has a 64-bit SimHash of its words, cut into `BLOCKS` blocks. Two prints that
   differ in `RADIUS` bits at most differ in some block by RADIUS div BLOCKS bits at most. Each item
   stands in the index under all block values so near to its own, so an equi join on (item size,
   item, block, value) finds every pair within the radius (the item is one that the document shares
   a shingle with: others have similarity 0). A bit count over the whole prints drops the rest.
3. Candidates are verified by the exact similarity of their shingles as strings, weighted by
   how often each occurs: twice the common weight over the sum of both.
4. The rescue, beside that path and apart from it: a fingerprint is a sketch, and a window of similarity
   0.8 may lie beyond any radius, for instance where one word fills it. Pairs beyond the radius whose
   common shingles, counted from above, may reach 0.8 are verified, too. `rescue=False` leaves that out.

A document is contaminated by an item whose similarity to a window is 0.8 or more.

Nulls and edge cases: a null or empty text has no words; an item of fewer than five words has no
shingle and contaminates nothing; a document shorter than an item is one window; rows and items
may repeat; ids may be null; no rows, or no items, give no rows. `decontaminated` passes all
columns through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfcast.functions.tables import written
from shelfcast.llm.common import fresh, table

SHINGLE = 5
SIMILARITY = 0.8
# Scattered changes that leave 0.8 of the shingles differ in one word in ten, 7 bits of 64. A change
# at one end differs in two in ten, 13 bits, and repeated words in any number.
RADIUS = 19
BITS = 64
# Eight bits a block, so an item stands under the 37 values within two bits of its own, eight times.
BLOCKS = 8
# A seed that many documents hold is shared by so many tasks.
SALTS = 16
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def shingles(split: str) -> Column:
    """All runs of five words of an array of words, as strings."""
    places = F.when(F.size(split) >= SHINGLE, F.sequence(F.lit(1), F.size(split) - (SHINGLE - 1)))
    return F.transform(
        F.coalesce(places, F.array().cast("array<int>")),
        lambda i: F.array_join(F.slice(F.col(split), i, F.lit(SHINGLE)), " "))


def fingerprint(hashes: Column) -> Column:
    """64-bit SimHash: a bit is set where more than half of the word hashes have it set."""
    def ones(bit: Column) -> Column:
        return F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, bit).cast("int"))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"),
        lambda bits, bit: F.when(ones(bit) * 2 > F.size(hashes), bits.bitwiseOR(F.call_function(
            "shiftleft", F.lit(1).cast("long"), bit))).otherwise(bits))


def prepared_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, n, item_print) of the items that have a shingle; written."""
    split = benchmark.select("item_id", words(F.col("text")).alias("item_words"))
    split = split.filter(F.size("item_words") >= SHINGLE).distinct()
    hashed = split.withColumn("h", F.transform("item_words", lambda w: F.xxhash64(w)))
    return written(hashed.select("item_id", "item_words", F.size("item_words").alias("n"), fingerprint(F.col("h")).alias("item_print")), "items")


def _hashed_shingles(hashes: str) -> Column:
    at = [lambda i, k=k: F.col(hashes)[i + k] for k in range(SHINGLE)]
    places = F.when(F.size(hashes) >= SHINGLE, F.sequence(F.lit(0), F.size(hashes) - SHINGLE))
    return F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.xxhash64(*[a(i) for a in at]))


def windows(keyed: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n, start): item-sized windows of documents at every 0-based start where enough shingles of items lie;
    and (key, n, item_id): the items of that size that share a shingle with the document."""
    def placed(df: DataFrame, split: Column, *carried: str) -> DataFrame:
        hashed = df.select(*carried, F.transform(split, lambda w: F.xxhash64(w)).alias("h"))
        return hashed.select(*carried, F.size("h").alias("n_words"), F.posexplode(_hashed_shingles("h")).alias("place", "seed"))

    laid_items = written(placed(items, F.col("item_words"), "item_id", "n").select("seed", "n", "item_id").distinct(), "item-shingles")
    salts, salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))), lambda *by: F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")
    # Items by (shingle, size): one row stands for all items that have it.
    seeds = written(laid_items.select("seed", "n").distinct().withColumn("salt", salts), "seeds")
    split = placed(keyed, words(F.col("text")), "key").withColumn("salt", salt("key", "place"))
    met = written(split.join(seeds, ["seed", "salt"]).select("key", "n", "seed", "place", "n_words").distinct(), "met")
    # What two bags of shingles have in common is at most the places of one whose shingle the other has, and the
    # similarity is twice that over the places of both: it takes two places in five of both. Only whole texts
    # that have as many are cut into windows.
    both = F.least("n_words", "n") + F.col("n") - 2 * (SHINGLE - 1)
    enough = lambda hits: hits >= F.ceil(both * F.lit(round(SIMILARITY * 50)) / 100)
    long_enough = met.groupBy("key", "n", "n_words").agg(F.collect_set("place").alias("places")).filter(enough(F.size("places")))
    first = F.greatest(F.col("place") - F.col("n") + SHINGLE, F.lit(0))
    starts = F.sequence(first, F.least("place", F.greatest(F.col("n_words") - F.col("n"), F.lit(0))))
    held = (
        long_enough.withColumn("place", F.explode("places")).select("key", "n", "n_words", F.explode(starts).alias("start"))
        .groupBy("key", "n", "n_words", "start").agg(F.count(F.lit(1)).alias("hits")).filter(enough(F.col("hits"))))
    laid = written(held.select("key", "n", "start"), "windows")
    holders = laid_items.withColumn("salt", salts)
    kept = met.select("key", "n", "seed").distinct().join(laid.select("key", "n").distinct(), ["key", "n"], "left_semi")
    shared = kept.withColumn("salt", salt("key")).join(holders, ["seed", "n", "salt"])
    return laid, written(shared.select("key", "n", "item_id").distinct(), "windowed-items")


def block_of(bits: Column, block: int) -> Column:
    """The value of one block of a print."""
    width = BITS // BLOCKS
    return F.shiftrightunsigned(bits, block * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def probes(prints: DataFrame, bits: str, radius: int = RADIUS) -> DataFrame:
    """`prints` under (block, value) for every value within radius div BLOCKS bits of its own."""
    width = BITS // BLOCKS
    flips = [v for v in range(1 << width) if v.bit_count() <= radius // BLOCKS]
    at = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), block_of(F.col(bits), b).alias("own")) for b in range(BLOCKS)]))
    flipped = F.explode(F.array(*[F.lit(v) for v in flips]))
    return prints.withColumn("at", at).withColumn("flip", flipped).select(
        *prints.columns, "at.block", F.col("at.own").bitwiseXOR(F.col("flip")).alias("value"))


def within_radius(left: DataFrame, right: DataFrame, on: list[str], left_bits: str, right_bits: str,
                  radius: int = RADIUS) -> DataFrame:
    """All pairs of equal `on` whose prints differ in `radius` bits at most, each once."""
    blocks = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), block_of(F.col(left_bits), b).alias("value")) for b in range(BLOCKS)]))
    cut = left.withColumn("at", blocks).select(*left.columns, "at.block", "at.value")
    met = cut.join(probes(right, right_bits, radius), [*on, "block", "value"])
    near = met.filter(F.bit_count(F.col(left_bits).bitwiseXOR(F.col(right_bits))) <= radius)
    return near.drop("block", "value").distinct()


def contaminations(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   radius: int = RADIUS, rescue: bool = True) -> DataFrame:
    """(key, doc_id, item_id, similarity, start): the best window of each document for each item.

    `key` is a hash of id and text, see `key_of`.
    """
    items = prepared_items(benchmark)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), key_of(doc_id, text).alias("key"))
    laid, shared = windows(keyed, items)
    # Only documents with a window go on; their list is written, so that its size is known.
    held = written(laid.select("key").distinct(), "windowed")
    texts = written(keyed.join(held, "key", "left_semi").distinct(), "windowed-texts")
    cut = (
        texts.select("key", words(F.col("text")).alias("w")).distinct().join(laid, "key")
        .select("key", "n", "start", F.slice("w", F.col("start") + 1, F.col("n")).alias("window_words")))
    printed = written(
        cut.withColumn("h", F.transform("window_words", lambda w: F.xxhash64(w)))
        .select("key", "n", "start", "window_words", fingerprint(F.col("h")).alias("window_print")), "window-prints")
    narrow = printed.select("key", "n", "start", "window_print").join(shared, ["key", "n"])
    item_prints = items.select("item_id", "n", "item_print").distinct()
    same = ["item_id", "n"]
    near = within_radius(narrow, item_prints, same, "window_print", "item_print", radius).withColumn("near", F.lit(True))
    if rescue:
        far = F.bit_count(F.col("window_print").bitwiseXOR(F.col("item_print"))) > radius
        near = near.unionByName(narrow.join(item_prints, same).filter(far).withColumn("near", F.lit(False)))
    # Few bytes but much work a row: a fixed number of partitions keeps them from being merged.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = near.select("key", "n", "start", "item_id", "item_print", "near").join(
        printed.select("key", "n", "start", "window_words"), ["key", "n", "start"]).join(
        items.select("item_id", "n", "item_words", "item_print"), ["item_id", "n", "item_print"])
    sets = pairs.repartition(tasks, "key", "item_id").select(
        "key", "item_id", "start", "near", shingles("window_words").alias("a"), shingles("item_words").alias("b"))
    # Each distinct shingle of one side that the other lacks takes one from what may be common.
    most = F.least(F.size("a") - F.size(F.array_except("a", "b")), F.size("b") - F.size(F.array_except("b", "a")))
    sets = sets.filter(F.col("near") | (most * 2.0 / (F.size("a") + F.size("b")) >= SIMILARITY))

    def times(side: str, shingle: Column) -> Column:
        return F.size(F.filter(F.col(side), lambda other: other == shingle))

    counted = F.aggregate(F.array_distinct("b"), F.lit(0), lambda n, s: n + F.least(times("a", s), times("b", s)))
    # Where one side has each shingle once, no shingle counts twice; only the others are counted one by one.
    once = (F.size(F.array_distinct("a")) == F.size("a")) | (F.size(F.array_distinct("b")) == F.size("b"))
    common = F.when(once, F.size(F.array_intersect("a", "b"))).otherwise(counted)
    verified = sets.select("key", "item_id", "start", (common * 2.0 / (F.size("a") + F.size("b"))).alias("similarity"))
    best = (
        verified.filter(F.col("similarity") >= SIMILARITY).groupBy("key", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")))
    named = texts.select("key", "doc_id").distinct()
    return best.join(named, "key").select(
        "key", "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start"))


def key_of(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(doc_id).isNull(), F.col(text), F.col(text).isNull())


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without those that hold a benchmark item."""
    key = fresh(docs, "_key")
    found = written(contaminations(docs, benchmark, doc_id, text).select(F.col("key").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, key_of(doc_id, text)).join(found, key, "left_anti").select(*docs.columns)


def op9_simhash_windows(spark, sf_dir: str) -> DataFrame:
    found = contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) >= 5),
ds AS (SELECT r, len(w) AS m, unnest(range(0, len(w) - 4)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s
       FROM d WHERE len(w) >= 5),
s AS (SELECT item_id, len(w) AS n, unnest(range(0, len(w) - 4)) AS q, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i),
laid AS (SELECT DISTINCT r, n, greatest(least(p - q, greatest(m - n, 0)), 0) AS start FROM ds JOIN s USING (s)),
cut AS (SELECT r, n, start, d.w[start + 1:start + n] AS w FROM laid JOIN d USING (r)),
cs AS (SELECT r, n, start, s, count(*) AS c FROM (
  SELECT r, n, start, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM cut) GROUP BY ALL),
bs AS (SELECT item_id, n, s, count(*) AS c FROM s GROUP BY ALL),
ct AS (SELECT r, n, start, sum(c) AS t FROM cs GROUP BY ALL),
bt AS (SELECT item_id, n, sum(c) AS t FROM bs GROUP BY ALL),
common AS (SELECT r, n, start, item_id, sum(least(cs.c, bs.c)) AS k FROM cs JOIN bs USING (n, s) GROUP BY ALL),
verified AS (SELECT r, item_id, start, k * 2.0::DOUBLE / (ct.t + bt.t) AS similarity
             FROM common JOIN ct USING (r, n, start) JOIN bt USING (item_id, n)),
best AS (SELECT r, item_id, start, similarity FROM verified WHERE similarity >= 0.8
         QUALIFY row_number() OVER (PARTITION BY r, item_id ORDER BY similarity DESC, start) = 1)
SELECT doc_id, item_id, similarity, start::INTEGER AS start FROM best JOIN d USING (r)
"""
