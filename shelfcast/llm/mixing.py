"""Mixing sources to target weights by systematic sampling.

Every document of a source expects `target / size of the source` copies. The expected copies
are prefix-summed within the source, one random offset per source is added, and a document is
taken once for each integer its stretch of the sum crosses. Documents are summed in order of
size, so the words taken from a source miss its target by less than its largest document.

Nulls and edge cases: a null text has size 0; a null source is a source of its own, sorted
last; a source without words has target 0 and its documents are not taken; a table without
rows gives no rows. Repeated rows are separate documents. Other columns pass through.
Documents equal in id and size are ordered by their texts, so a rerun takes the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.functions.tables import written
from shelfcast.llm.common import fresh, numbered, table, word_count

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = "mix"
# Offsets lie on a grid, so that offset + a whole number of copies stays exact in a double.
OFFSET_STEPS = 65536


def source_targets(sized: DataFrame, source: str, size: str, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target): the sources share all sizes by weight.

    Targets stop at `max_copies` times their source's size; the excess goes to the others by
    weight. That is a water level: target = least(cap, level * weight). With caps sorted by
    cap / weight, the level is the largest of (total - caps so far) / (weights to come).
    The windows see one row per source.
    """
    per_source = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = per_source.withColumn(
        "weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * max_copies)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    caps_before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights_left = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    return (
        weighed.withColumn("level", (F.sum("source_size").over(everything) - caps_before) / weights_left)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size",
                F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target")))


def _offset(source: Column, seed: str) -> Column:
    name = F.when(source.isNull(), F.lit(f"{seed}|")).otherwise(F.concat(F.lit(f"{seed}="), source))
    return F.conv(F.substring(F.md5(name), 1, 4), 16, 10).cast("double") / OFFSET_STEPS


def planned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
            size: str | None = None, then: tuple[str, ...] = (), weights=WEIGHTS, max_copies: int = MAX_COPIES,
            seed: str = SEED) -> DataFrame:
    """`docs` with source_size, target and `copies`, the times the mix takes each row.

    `size` names a column of sizes; without it the words of `text` are counted. `then` names
    columns that order rows of equal size and id.
    """
    words, rank, copies = fresh(docs, "_words"), fresh(docs, "_rank"), fresh(docs, "copies")
    sized = docs.withColumn(words, F.col(size) if size else word_count(F.col(text)))
    tie = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    ranked = numbered(sized, source, [F.col(words), tie, F.col(doc_id), *map(F.col, then)], rank, "mix")
    targets = written(source_targets(sized.select(source, words), source, words, weights, max_copies), "targets")
    each = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(F.lit(0.0))
    start = _offset(F.col(f"r.{source}"), seed)
    crossed = F.floor(start + (F.col(rank) + 1) * each) - F.floor(start + F.col(rank) * each)
    return (
        ranked.alias("r").join(targets.alias("t"), F.col(f"r.{source}").eqNullSafe(F.col("t.source")))
        .select(*[F.col(f"r.{c}") for c in docs.columns], F.col(f"r.{words}").alias(words),
                F.col("t.source_size").alias(fresh(docs, "source_size")), F.col("t.target").alias(fresh(docs, "target")),
                # The crossings of a stretch of at most `max_copies`; `least` only meets rounding.
                F.least(crossed, F.lit(max_copies)).cast("long").alias(copies)))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          size: str | None = None, **options) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with the columns of `docs`.

    Rows are written once with their number and size. Only these travel to be ordered, so long
    texts do not gather in the task of the largest sizes; texts are met again by row number.
    """
    row, words, content, copies = (fresh(docs, c) for c in ("_row", "_words", "_content", "_copies"))
    whole = written(docs.select(
        "*", F.monotonically_increasing_id().alias(row),
        (F.col(size) if size else word_count(F.col(text))).alias(words), F.xxhash64(text).alias(content)), "mix-rows")
    narrow = whole.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), row, words, content)
    plan = planned(narrow, source="source", size=words, then=(content,), **options)
    # Written, so that Spark can weigh the join by its size.
    taken = written(plan.filter("copies > 0").select(row, F.col("copies").cast("int").alias(copies)), "mix-taken")
    each = F.explode(F.array_repeat(F.lit(1), F.col(copies)))
    return whole.join(taken, row).select(*docs.columns, each.alias(copies)).drop(copies)


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    # Sizes are written first: the range bounds, the targets and the plan then read no text.
    sized = written(
        table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    plan = planned(sized, size="size")
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                       "source", "copies")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap
  FROM per_source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (
               ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS one_level
  FROM weighed),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, max(one_level) OVER () * weight) AS target,
         ('0x' || substr(md5(CASE WHEN source IS NULL THEN 'mix|' ELSE 'mix=' || source END), 1, 4))::BIGINT / 65536.0::DOUBLE AS start
  FROM levels),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY source ORDER BY size, md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id) AS k
  FROM sized),
crossed AS (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target, r.k, t.start,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, least(floor(start + k * each) - floor(start + (k - 1) * each), 3)::BIGINT AS copies FROM crossed)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken, source, copies FROM counted
"""
