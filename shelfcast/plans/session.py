"""Session settings the jobs rely on."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

SETTINGS = {
    # Dates and hours of a sale are read in one fixed zone.
    "spark.sql.session.timeZone": "UTC",
    # Split hot partitions of joins even where the split costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Streaming state on disk instead of the executors' heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # What a job shuffled is deleted when it ends, not when the driver happens to collect garbage: every result
    # that is read again is a written table, so the disk holds these and one job's shuffles.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Small inputs split over all cores; big ones still use full-size splits.
    "spark.sql.files.openCostInBytes": "524288",
}
SHUFFLE_BYTES = 192 * 1024 * 1024
# Columnar files are taken to grow about this much when their rows are sorted in memory (an estimate from the columns of a
# wide line). A partition that outgrows a task's memory is spilled, that is, written once more.
EXPANSION = 12


def prepared(spark: SparkSession) -> SparkSession:
    """Apply the settings, leaving alone what the application was configured with."""
    configured = spark.sparkContext.getConf()
    for key, value in SETTINGS.items():
        if configured.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of files or folders, from the file system's own summary."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    total = 0
    for text in paths:
        path = jvm.org.apache.hadoop.fs.Path(text)
        total += path.getFileSystem(conf).getContentSummary(path).getLength()
    return total


def sized_for(spark: SparkSession, paths: list[str]) -> SparkSession:
    """Raise the number of shuffle partitions until one fits in memory. Never lowers it;
    adaptive execution merges partitions that turn out small."""
    needed = math.ceil(input_bytes(spark, paths) * EXPANSION / SHUFFLE_BYTES)
    if needed > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(needed))
    return spark
