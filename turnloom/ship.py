"""Sends this package to the executors, so that functions of it run there without being installed."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application, hand a zip of the package to Spark, which serves it to every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    root = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp(prefix="spark-", dir=tempfile.gettempdir()))
    shutil.copytree(root, where / "code" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(where.resolve() / root.name), "zip", where / "code"))
    _done.add(sc.applicationId)
