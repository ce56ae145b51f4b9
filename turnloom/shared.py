"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoints(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one is made only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and where that is.

    Unlike a checkpoint, a table has its true size: sizes that Spark only estimates are multiplied with each join, which
    in a loop makes them numbers of millions of digits.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def table_or_empty(read: Callable[[], DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    """What read() finds, or no rows where its path does not exist."""
    try:
        return read()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The Hadoop file system of a path, and the path as it knows it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def task_files(root: str) -> tuple[FileSystem, str]:
    """A folder as tasks reach it, without the driver: pyarrow's file system of it, and the folder as that knows it."""
    return FileSystem.from_uri(re.sub("^file:/*", "/", root))  # a path without a scheme may have any sign


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


#: The setting of Spark for how many tasks list files, at most.
LISTINGS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listings(spark: SparkSession) -> Iterator[None]:
    """While files are named that are to be read: many paths are listed by a few tasks for each core, not by a task each."""
    old = spark.conf.get(LISTINGS)
    spark.conf.set(LISTINGS, str(min(int(old), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTINGS, old)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    fs, where = file_system(spark, path)
    fs.delete(where, True)


#: Rows of a few ids or numbers that may be broadcast: some 64 MB.
FEW_ROWS = 3_000_000


def broadcast_if_few(df: DataFrame, size: int = 1) -> DataFrame:
    """df: narrow rows, checkpointed. Broadcast when counted to be few, else joined as Spark sees fit.

    size: of a row, in rows of two numbers.
    """
    return F.broadcast(df) if size * df.count() <= FEW_ROWS else df


#: Bytes that may be broadcast where rows hold texts.
FEW_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, most: int = FEW_BYTES) -> DataFrame:
    """df: rows of any width, checkpointed. Broadcast when they are few and, written as text, have at most so many bytes."""
    size = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).agg(F.count("*").alias("rows"), F.sum("n").alias("bytes")).first()
    return F.broadcast(df) if size["rows"] <= FEW_ROWS and (size["bytes"] or 0) <= most else df


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read, dealt out evenly if it has fewer partitions than there are cores, as one small file has, which
    a single task would read and work through. Larger tables are left alone."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()
