"""Make this package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

import shelfcast

_shipped: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application. Harmless where it is installed."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = Path(shelfcast.__file__).resolve().parent
        folder = os.path.realpath(tempfile.mkdtemp(prefix="shelfcast-package-"))
        copy = shutil.copytree(package, f"{folder}/package/shelfcast", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/shelfcast", "zip", os.path.dirname(copy), "shelfcast"))
        _shipped.add(application)
    return spark
