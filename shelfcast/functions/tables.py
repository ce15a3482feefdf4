"""Written tables: the way this library cuts lineage and shares a result between jobs.

A table goes to the folder the cluster names in `spark.checkpoint.dir` (shared storage),
so it outlives lost executors, keeps columnar pruning, and carries a size Spark can check
before it chooses a broadcast.
"""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def _plain(folder: str) -> str:
    """The path of a `file:` folder, however its slashes are written; other folders as they are."""
    path = re.sub(r"^file:(//)?(?=/)", "", folder)
    return posixpath.normpath(path) if path.startswith("/") else path.rstrip("/")


def placed(spark: SparkSession, folder: str) -> str:
    """`folder`, unless it lies on one machine's disk while the executors run on others.

    A `file:` folder may be mounted everywhere; say so by setting `shelfcast.sharedFiles` to true. The folder
    in `spark.checkpoint.dir`, and any inside it, is shared: the cluster says so by naming it.
    """
    local = not re.match(r"[a-z][a-z0-9+.-]*:", folder) and spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:").startswith("file:")
    on_cluster = not spark.sparkContext.master.startswith("local")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    inside = bool(shared) and f"{_plain(folder)}/".startswith(f"{_plain(shared)}/")
    if on_cluster and (local or folder.startswith("file:")) and not inside and spark.conf.get("shelfcast.sharedFiles", "") != "true":
        raise RuntimeError(f"{folder} is a folder of one machine: give one that every executor can reach")
    return folder.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="shelfcast-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` once and return a reader of the written table.

    `by` names columns of few values: each value is a folder, which a filter on it reads alone.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/shelfcast/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"
    # Written once and read a few times: the smaller files are worth the harder compression.
    df.write.mode("error").option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def side_by_side(*builds: Callable[[], DataFrame]) -> list[DataFrame]:
    """Tables that do not need each other, built and written at the same time, in the order given.

    Each is its own chain of jobs; the cluster fills the cores that a small one leaves idle.
    """
    with ThreadPoolExecutor(len(builds)) as pool:
        return [ready.result() for ready in [pool.submit(build) for build in builds]]
