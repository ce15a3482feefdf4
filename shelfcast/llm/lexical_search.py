"""Ranked lexical search by term-at-a-time scoring with a limited number of accumulators.

1. Items and documents become terms; only occurrences of terms that some item asks for are kept,
   as postings (term, document, how often). A term's weight falls with the documents that hold it.
2. Terms are taken rarest first, in bands of document frequency: factors of 8 for rare terms, of 2
   for those that a sixty-fourth or more of the documents hold. So the bands, which are the
   rounds, grow with the logarithm of the number of documents, and postings of a band lie in a
   folder of their own. A round adds the band's scores to the accumulators (item, document).
3. After each band, what the terms still to come may add to any one document is known from each
   term's largest score. Once that is below an item's kth partial score, a document without an
   accumulator can no longer get in: the item stops creating them. Accumulators that cannot
   reach the kth score with all that remains go, too.
4. The survivors of stopped items get the scores of their remaining terms, exactly, by a join of
   (document, term) with the band's postings. Frequent terms thus meet few documents.

All accumulators of a round live in one table spread over (item, document): a term that most
documents hold is a hot key only of the join with the few rows of items that ask for it, which
Spark broadcasts, or splits where the items are many.

Nulls and edge cases: a null or empty text has no terms; an item without a term that some document
holds has no result; each row of either table counts by itself, so repeated rows are ranked
separately; equal scores go by doc_id, nulls last, then by the order in which rows are read; no
documents or no items give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.functions.tables import written
from shelfcast.llm.common import table

# A term is a run of anything but the ASCII characters that are neither letters nor digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 10
# Share of a document's length in its scores, in hundredths.
LENGTH_SHARE = 75
# Documents per holder of a term up to which bands are factors of 2, and how wide they are beyond.
FINE_UP_TO, COARSE = 64, 8


def terms(text: Column) -> Column:
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _band(total: Column, df: Column) -> Column:
    """0 for terms that more than half of the documents hold; larger for rarer ones."""
    ratio = total / df
    fine = F.floor(F.log2(ratio))
    coarse = F.log2(F.lit(float(FINE_UP_TO))) + F.floor(F.log2(ratio / FINE_UP_TO) / F.log2(F.lit(float(COARSE))))
    return F.when(ratio < FINE_UP_TO, fine).otherwise(coarse).cast("int")


def asked_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, term, times), one row per term of an item; `item` numbers the rows."""
    # Numbered before they are split: an explode beside it would number its own rows.
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), terms(F.col(text)).alias("all"))
    split = rows.select("item", "item_id", F.explode("all").alias("term"))
    return written(split.groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("times")), "asked")


def postings(docs: DataFrame, asked: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc, term, part, band), (term, df, most, band, weight) and (doc, doc_id): the index of the asked terms.

    `doc` numbers the rows. `part` is the score of one unit of weight, `most` the largest of the term.
    """
    # Each text also holds the empty term once, which stands for the whole: one scan gives all counts.
    empty = asked.sparkSession.createDataFrame([("",)], "term string")
    vocabulary = written(asked.select("term").distinct().unionByName(empty), "vocabulary")
    split = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(doc_id).alias("doc_id"), terms(F.col(text)).alias("all"))
    whole = F.col("term") == ""
    held = written(
        split.select("doc", "doc_id", F.size("all").cast("long").alias("n"), F.explode(F.concat("all", F.array(F.lit("")))).alias("term"))
        .join(vocabulary, "term").groupBy("doc", "n", "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.max(F.when(whole, F.col("doc_id"))).alias("doc_id")), "held")
    total, words = held.filter(whole).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # Without a word in the table there are no rows to divide for.
    normal = f"{100 - LENGTH_SHARE} + (({LENGTH_SHARE}L * n * {total}L) div {max(words, 1)}L)"
    parts = held.filter(~whole).select("doc", "term", F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * ({normal}))").alias("part"))
    stats = parts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("most"))
    stats = written(stats.withColumn("band", _band(F.lit(float(total)), F.col("df"))).withColumn(
        "weight", F.floor(1000 * F.log((2.0 * total + 2) / (2.0 * F.col("df") + 1))).cast("long")), "terms")
    index = written(parts.join(stats.select("term", "band"), "term").select("doc", "term", "part", "band"), "postings", by=("band",))
    return index, stats, held.filter(whole).select("doc", "doc_id")


def _numbered_best(scores: DataFrame, order: list[Column]) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), *order)))


def ranked(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, item_id, rank, doc, doc_id, score): the k best documents of every item."""
    asked = asked_terms(items, item_id, item_text)
    index, stats, names = postings(docs, asked, doc_id, text)
    gain = F.col("weight") * F.col("times")
    wanted = written(
        asked.join(stats, "term").select("item", "term", "band", gain.alias("gain"), (gain * F.col("most")).alias("bound")), "wanted")
    scores = wanted.select("item", F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("score")).limit(0)
    live = written(wanted.select("item").distinct(), "live")
    # About as many bands as the logarithm of the number of documents.
    for band in [r["band"] for r in stats.select("band").distinct().orderBy(F.desc("band")).collect()]:
        asks = wanted.filter(F.col("band") == band).select("item", "term", "gain")
        found = index.filter(F.col("band") == band).select("doc", "term", "part")
        created = asks.join(live, "item").join(found, "term")
        stopped = scores.join(live, "item", "left_anti").join(asks, "item").select("item", "doc", "term", "gain")
        updated = stopped.join(found, ["doc", "term"])
        added = [df.select("item", "doc", (F.col("gain") * F.col("part")).alias("score")) for df in (created, updated)]
        made = written(
            scores.unionByName(added[0]).unionByName(added[1]).groupBy("item", "doc").agg(F.sum("score").alias("score")),
            f"accumulators-{band}")
        kth = _numbered_best(made, []).filter(F.col("rank") == k).select("item", F.col("score").alias("kth"))
        coming = wanted.filter(F.col("band") < band).groupBy("item").agg(F.sum("bound").alias("rest"))
        bounds = written(kth.join(coming, "item", "left").select("item", "kth", F.coalesce("rest", F.lit(0)).alias("rest")), "bounds")
        # An item below k accumulators has no bound, and keeps all of them.
        scores = made.join(bounds, "item", "left").filter(
            F.col("kth").isNull() | (F.col("score") + F.col("rest") >= F.col("kth"))).select("item", "doc", "score")
        live = written(live.join(bounds.filter(F.col("rest") < F.col("kth")), "item", "left_anti"), "live")
    # Ties of the kth score are still there, and are few.
    last = written(scores.filter(F.col("score") > 0), "survivors")
    named = names.join(last, "doc").select("item", "doc", "doc_id", "score")
    best = _numbered_best(named, [F.col("doc_id").asc_nulls_last(), F.col("doc")]).filter(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id").distinct(), "item").select("item", "item_id", "rank", "doc", "doc_id", "score")


def op13_limited_accumulators(spark, sf_dir: str) -> DataFrame:
    found = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM benchmark),
g AS (SELECT count(*)::BIGINT AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
tf AS (SELECT doc, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
q AS (SELECT item, item_id, term, count(*)::BIGINT AS times FROM (SELECT item, item_id, unnest(t) AS term FROM b) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT AS w FROM df, g),
scored AS (
  SELECT item, item_id, doc, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), g GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, doc)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, doc) <= 10
"""
