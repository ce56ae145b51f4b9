"""Files that are new or have changed since the last run, among them those that grew under their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators.manifest import pending
from ..shared import broadcast_if_small, checkpoint, table_or_empty
from .files import _literal, _name
from .snapshots import commit, read_snapshot, versions

#: What is known of each file: as it was when it was last read.
LEDGER = "path string, mtime timestamp, size long, hash string"


def changed_files(spark: SparkSession, path: str, ledger: DataFrame, glob: str = "*.md", by_content: bool = False) -> DataFrame:
    """Files (path, mtime, size, content, hash) of a folder that are not in the ledger as they are now, checkpointed.

    Folders are listed without reading files; one whose time and size are those of the ledger is unchanged (by_content:
    its content is compared all the same). The others are read once. `same` says that such a file's content is that of the
    ledger. A file that is written to while it is read counts as read, and comes again in the next run. Spark reads no empty
    files: one comes as soon as it has content.
    """
    read = lambda *where: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(list(where))
    kind = "path string, modificationTime timestamp, length long"
    now = table_or_empty(lambda: read(path).select("path", "modificationTime", "length"), spark, kind)
    known = ledger.select("path", F.col("mtime").alias("__mtime"), F.col("size").alias("__size"), F.col("hash").alias("__hash"))
    seen = F.col("__mtime").eqNullSafe(F.col("modificationTime")) & F.col("__size").eqNullSafe(F.col("length"))
    fresh = now.join(known, "path", "left").where(F.lit(by_content) | ~seen).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "__hash")
    fresh = checkpoint(fresh)
    paths = [_literal(r["path"]) for r in fresh.select("path").toLocalIterator()]  # paths that changed, as a read lists them
    content = read(*paths).select("path", "content") if paths else spark.createDataFrame([], "path string, content binary")
    hashed = fresh.join(content, "path").withColumn("hash", content_hash("content"))
    return checkpoint(hashed.select("path", "mtime", "size", F.col("content").cast("string").alias("content"), "hash", F.coalesce(F.col("__hash") == F.col("hash"), F.lit(False)).alias("same")))


def run_changes(spark: SparkSession, path: str, ledger: str, step: Callable[[DataFrame, int], None], glob: str = "*.md", by_content: bool = False) -> int | None:
    """Hands the files (file, path, content, hash) that changed since the last run to step, with the run's number, and then
    commits the ledger (a table with versions at that path). Returns the number, or None where nothing changed.

    If step fails, or the run is lost before its commit, the next run hands over the same files under the same number, as
    they are then; so step is to replace what it has written under that number.
    """
    known = versions(spark, ledger)
    number = known[-1] + 1 if known else 1
    found = changed_files(spark, path, read_snapshot(spark, ledger, LEDGER), glob, by_content)
    if found.isEmpty():
        return None
    new = found.where("not same")
    some = not new.isEmpty()
    if some:
        step(new.select(_name(F.col("path")).alias("file"), "path", "content", "hash"), number)
    row = found.select("path", "mtime", "size", "hash")
    commit(spark, ledger, LEDGER, lambda old: old.join(broadcast_if_small(row.select("path")), "path", "left_anti").unionByName(row))
    return number if some else None


def incremental_logs(spark: SparkSession, path: str, ledger: str, manifest: Callable[[], DataFrame], compile_batch: Callable[[DataFrame, int], None]) -> int | None:
    """Compiles the daily logs of a folder that are new, or were appended to, since the last run: of what run_changes finds,
    compile_batch gets what is pending against the manifest as it is then."""
    return run_changes(spark, path, ledger, lambda batch, number: compile_batch(pending(batch, manifest()), number))
