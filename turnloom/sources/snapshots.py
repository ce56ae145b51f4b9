"""Small tables with versions: each commit is a whole snapshot, and a pointer to it that is created once or not at all.

A table at path has snapshots/<name>, a Parquet table each, and versions/<number>, a file that names the snapshot of that
version. A commit reads the latest version, writes what it makes of it as a new snapshot, and then creates the pointer of
the next number. If another writer has created it meanwhile, the snapshot is discarded and the change made anew on what
that writer committed. So no commit is lost, and readers see one whole version.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shared import file_system, forget

#: Attempts of a commit, and the longest pause before the next one in seconds.
ATTEMPTS, PAUSE = 50, 2.0


class CommitConflict(RuntimeError):
    """Other writers were faster at every attempt."""


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all versions, in order."""
    fs, where = file_system(spark, f"{path}/versions")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n) for n in names if n.isdigit())


def _pointed(spark: SparkSession, path: str, version: int) -> str:
    fs, where = file_system(spark, f"{path}/versions/{version:020d}")
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def read_snapshot(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The table as of a version, or as of the latest; no rows where there is none yet. A version that does not exist is an
    error."""
    known = versions(spark, path)
    if version is None:
        version = known[-1] if known else None
    elif version not in known:
        raise ValueError(f"{path} has no version {version}")
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/snapshots/{_pointed(spark, path, version)}")


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with all its text, unless it exists: then False, whoever else tries at the same time.

    The text is written to a file of its own first. On a local file system that gets a second name, which fails where the
    name is taken; elsewhere it is renamed, which on HDFS and file systems like it fails then, too. An object store needs
    one that renames without overwriting.
    """
    jvm = spark.sparkContext._jvm
    fs, target = file_system(spark, path)
    own = jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    fs.mkdirs(own.getParent())
    out = fs.create(own, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.String, 0))
            jvm.java.nio.file.Files.createLink(local(target), local(own))
            return True
        return bool(not fs.exists(target) and fs.rename(own, target))
    except Exception as taken:
        if "FileAlreadyExists" in str(taken):
            return False
        raise
    finally:
        if fs.exists(own):
            fs.delete(own, False)


def commit(spark: SparkSession, path: str, schema: str, change: Callable[[DataFrame], DataFrame], attempts: int = ATTEMPTS) -> int:
    """Commits change(the latest version) as the next version, and returns its number; the first one is 1.

    change may be called several times, each time with what others have committed meanwhile.
    """
    for attempt in range(attempts):
        known = versions(spark, path)
        base = known[-1] if known else 0
        name = uuid.uuid4().hex
        change(read_snapshot(spark, path, schema, base or None)).to(spark.createDataFrame([], schema).schema).write.parquet(f"{path}/snapshots/{name}")
        if _create(spark, f"{path}/versions/{base + 1:020d}", name):
            return base + 1
        forget(spark, f"{path}/snapshots/{name}")
        time.sleep(random.uniform(0, min(PAUSE, 0.05 * 2**attempt)))
    raise CommitConflict(f"{path}: {attempts} attempts")


def expire(spark: SparkSession, path: str, keep: int = 10) -> int:
    """Deletes all versions but the last `keep`, oldest first, and returns how many; their readers must be done."""
    if keep < 1:
        raise ValueError("the last version stays")
    old = versions(spark, path)[:-keep]
    for v in old:
        name = _pointed(spark, path, v)
        forget(spark, f"{path}/versions/{v:020d}")
        forget(spark, f"{path}/snapshots/{name}")
    return len(old)
