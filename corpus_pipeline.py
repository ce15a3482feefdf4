"""The corpus pipeline: documents through the stages below, each on all that the last one kept.

Each stage takes (spark, docs, sf_dir) and returns documents; its rows are written and read
again as the next one's input. All but the last keep the columns of documents, extra ones included.

Nulls and edge cases: a null text is scored as an empty one, and either has no near copies and holds no
passage; of rows equal in id and text one stays; of near copies the smallest id stays. Ids may be null or repeat,
rows are told apart by id and text. A null source is a source of its own; a source without words is not taken
into the mix. Extra columns pass through, but `shard` and `slot`, which the last stage replaces. No documents
give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfcast.functions.tables import shared_folder
from shelfcast.llm import toxicity
from shelfcast.llm.common import table
from shelfcast.llm.decontaminate import decontaminated
from shelfcast.llm.mixing import mixed
from shelfcast.llm.ngram_join import deduplicated
from shelfcast.llm.sharding import sharded


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the cut, by a model fitted on the labels of `sf_dir`."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of `benchmark`."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return sharded(docs)


STAGES = [
    ("toxicity", reject_toxic), ("ngram_jaccard_join", deduplicate), ("decontamination", decontaminate),
    ("mixing", mix), ("sharding", shard),
]

# The first stage learns from labels, so SQL cannot express the rows; tests hold the stages
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/shelfcast/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex[:8]}"
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(result.schema).parquet(f"{folder}/{name}")
    return docs
