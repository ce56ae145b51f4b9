"""Reading transcripts, logs, articles and hook payloads from files, and writing what sessions leave."""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import article_key, content_hash, py_strip
from ..operators.articles import EMPTY_INDEX, KINDS
from ..shared import broadcast_if_small, checkpoint, exists, few_listings, file_system, table_or_empty, task_files
from ..ship import ship

#: A backslash by itself, not before a quote. Fixed value.
LONE_BACKSLASH = r'(?<!\\)\\(?!["\\])'


def _decoded(path: Column) -> Column:
    """A path that Spark reports as it is on disk; a plus sign stands for itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _name(path: Column) -> Column:
    return _decoded(F.regexp_extract(path, r"([^/]*)\z", 1))


def _place_in_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the lines of each split, which stand in order."""
    last, n = None, 0
    for b in batches:
        keys = list(zip(b.column("p").to_pylist(), b.column("block").to_pylist(), strict=True))
        at = np.empty(len(keys), np.int64)
        for k, key in enumerate(keys):
            n = n + 1 if key == last else 0
            at[k], last = n, key
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "at"])


def _unsplit(spark: SparkSession) -> int:
    """Bytes that a file must have to be read in several splits."""
    bytes_of = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    return min(bytes_of(spark.conf.get(f"spark.sql.files.{k}")) for k in ("maxPartitionBytes", "openCostInBytes"))


def numbered_lines(spark: SparkSession, where: str | list[str], **options: object) -> DataFrame:
    """Lines of text files with their numbers from 0: (p, line_no, raw), p the file as Spark reports it.

    Lines end with \\n, \\r or both. A long file is read in splits: a line's number is its place in its split, and the lines
    of the splits before, which are counted first; files that are too small for several splits are left out there.
    """
    with few_listings(spark):
        files = spark.read.options(**options).text(where)
    lines = files.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw"))
    long = files.where(F.col("_metadata.file_size") > _unsplit(spark)).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("block"))
    counts = long.groupBy("p", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("p").orderBy("block")) - F.col("n")
    starts = checkpoint(counts.select("p", "block", before.alias("start")).where("block > 0"))
    ship(spark)
    placed = lines.mapInArrow(_place_in_split, "p string, block long, raw string, at long")
    number = F.col("at") + F.coalesce("start", F.lit(0).cast("long"))
    return placed.join(broadcast_if_small(starts), ["p", "block"], "left").select("p", number.cast("int").alias("line_no"), "raw")


def read_transcripts(spark: SparkSession, path: str, subagents: bool = False) -> DataFrame:
    """transcript_lines of *.jsonl files in path; subagents: of */subagents/*.jsonl, by the session they belong to. A file
    of any length is read in splits."""
    lines = numbered_lines(spark, f"{path}/*/subagents/*.jsonl" if subagents else f"{path}/*.jsonl")
    stem = F.regexp_replace(_name(F.col("p")), r"\.jsonl\z", "")
    session = _decoded(F.regexp_extract("p", r"([^/]*)/subagents/[^/]*\z", 1)) if subagents else stem
    return lines.select(session.alias("session_id"), (stem if subagents else F.lit("")).alias("subagent"), "line_no", "raw")


def plain_path(path: Column) -> Column:
    """A path without its scheme and doubled slashes, so that one that a payload names and one that Spark reports compare."""
    return F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), "/+", "/")


def _literal(name: str) -> str:
    """A name as part of a glob that matches it alone."""
    return re.sub(r"([\\{}\[\]*?,^])", r"\\\1", name)


def _there(spark: SparkSession, paths: list[str], folders: bool) -> list[str]:
    """Those of the paths that are files, or folders."""

    path_of, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()

    def found(path: str) -> bool:
        where = path_of(path)
        fs = where.getFileSystem(conf)
        return fs.isDirectory(where) if folders else fs.isFile(where)

    with ThreadPoolExecutor(16) as several:
        return [path for path, there in zip(paths, several.map(found, paths), strict=True) if there]


def read_named_transcripts(spark: SparkSession, paths: list[str], subagents: bool = False) -> DataFrame:
    """transcript_lines of the files named, or of the subagents of their sessions; session_id is the plain_path of the
    session's file. Only these files are listed and read: each is looked up by its name, however many its folder has.
    Names that are no absolute path, and files that are not there, have no lines."""
    schema = "session_id string, subagent string, line_no int, raw string"
    named = [m for p in sorted(set(paths)) if (m := re.fullmatch(r"(?s)((?:[A-Za-z][A-Za-z0-9+.-]*:)?/(?:.*/)?)([^/]+)", p))]
    stem = lambda n: n.rsplit(".", 1)[0] if "." in n[1:] else n
    place = {m[0]: f"{m[1]}{stem(m[2])}/subagents" if subagents else m[0] for m in named}
    there = _there(spark, sorted(set(place.values())), subagents)
    if not there:
        return spark.createDataFrame([], schema)
    only = {"pathGlobFilter": "*.jsonl", "recursiveFileLookup": True} if subagents else {}
    files = numbered_lines(spark, [_literal(p) for p in there], **only).withColumn("p", plain_path(_decoded(F.col("p"))))
    if not subagents:
        return files.select(F.col("p").alias("session_id"), F.lit("").alias("subagent"), "line_no", "raw")
    of = spark.createDataFrame([(d, p) for p, d in place.items()], "dir string, session_id string").select(plain_path(F.col("dir")).alias("dir"), plain_path(F.col("session_id")).alias("session_id")).distinct()
    agent = F.regexp_replace(F.regexp_extract("p", r"([^/]*)\z", 1), r"\.jsonl\z", "")
    held = files.withColumn("dir", F.regexp_extract("p", r"(?s)\A(.*)/[^/]*\z", 1)).join(F.broadcast(of), "dir")
    return held.select("session_id", agent.alias("subagent"), "line_no", "raw")


def _depth(path: Column) -> Column:
    return F.length(F.regexp_replace(plain_path(path), "[^/]", ""))


def _directly_in(spark: SparkSession, path: Column, folder: str) -> Column:
    """Whether a file that Spark found below a folder is in it and no deeper."""
    fs, where = file_system(spark, folder)
    return _depth(path) == _depth(F.lit(fs.makeQualified(where).toString())) + 1


#: Names that a listing hands on together, bytes of files that a read does, and files that a task reads, about.
NAMES, READ_BYTES, FILES = 10_000, 1 << 23, 10_000


def _tasks_reach(spark: SparkSession, folder: str) -> str | None:
    """An existing folder's name for task_files, or None where only Spark's readers know it: other file systems, and globs."""
    fs, where = file_system(spark, folder)
    if not fs.exists(where):
        return None
    name = fs.makeQualified(where).toString()
    try:
        task_files(name)
    except (pa.ArrowInvalid, OSError):
        return None
    return name


def _list_folders(spark: SparkSession, folders: list[str], suffix: str) -> DataFrame:
    """(folder, name, mtime, size), checkpointed: the files right in the folders that Spark would read. A task lists a folder, and
    the driver sees no file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k in rows["id"]:
                fs, base = task_files(folders[k])
                found = fs.get_file_info(FileSelector(base))
                for start in range(0, len(found), NAMES):
                    some = [(folders[k], f.base_name, f.mtime_ns // 1000, f.size) for f in found[start : start + NAMES] if f.type == FileType.File and f.size]
                    yield pd.DataFrame(some, columns=["folder", "name", "us", "size"])

    ship(spark)
    files = spark.range(0, len(folders), 1, len(folders)).mapInPandas(run, "folder string, name string, us long, size long")
    hidden = F.col("name").rlike(r"\A(\.|_[^=]*\z)")
    mtime = F.timestamp_millis(F.expr("us div 1000"))
    return checkpoint(files.where(F.col("name").endswith(suffix) & ~hidden).select("folder", "name", mtime.alias("mtime"), "size"))


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files (folder, name) with their bytes, some READ_BYTES at a time."""
    known, rows, held = {}, [], 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], names=["folder", "name", "content"])

    for b in batches:
        for folder, name in zip(b.column("folder").to_pylist(), b.column("name").to_pylist(), strict=True):
            if folder not in known:
                known[folder] = task_files(folder)
            fs, base = known[folder]
            with fs.open_input_file(f"{base}/{name}") as f:
                rows.append((folder, name, f.read()))
            held += len(rows[-1][2])
            if held >= READ_BYTES or len(rows) >= NAMES:
                yield done()
                rows, held = [], 0
    if rows:
        yield done()


def list_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts in path by time of change: session, its id's first eight characters, date, size."""
    if folder := _tasks_reach(spark, path):
        files = _list_folders(spark, [folder], ".jsonl")
        stem = F.regexp_replace("name", r"\.jsonl\z", "")
    else:
        found = spark.read.format("binaryFile").options(pathGlobFilter="*.jsonl", recursiveFileLookup=True).load(path)  # one folder, not a path a file
        files = found.select(F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.col("_metadata.file_path").alias("p")).where(_directly_in(spark, F.col("p"), path))
        stem = F.regexp_replace(_name(F.col("p")), r"\.jsonl\z", "")
    return files.select(stem.alias("session_id"), F.left(stem, F.lit(8)).alias("short_id"), "mtime", F.to_date("mtime").alias("date"), "size").orderBy("mtime", "session_id")


def latest_source(sessions: DataFrame, dir_col: str = "dir") -> DataFrame:
    """Of several folders (dir, mtime) the one with the newest file."""
    by_dir = sessions.groupBy(dir_col).agg(F.coalesce(F.max("mtime"), F.timestamp_seconds(F.lit(0))).alias("mtime"))
    return by_dir.agg(F.max_by(dir_col, F.struct("mtime", dir_col)).alias(dir_col))


def read_daily_logs(spark: SparkSession, path: str) -> DataFrame:
    """daily_logs of *.md files: the content and its hash in one pass."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
    name = _name(F.col("path"))
    return files.select(name.alias("file"), F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date").alias("log_date"), F.col("content").cast("string").alias("content"), content_hash("content").alias("hash"))


def read_articles(spark: SparkSession, root: str) -> DataFrame:
    """Articles (kind, path, key, content) of the folders concepts, connections and qa, not deeper. Tasks list the folders, one
    each, and read the files, so that no file is known to the driver, however many there are."""
    schema = "kind string, path string, key string, content string"
    reached = {kind: _tasks_reach(spark, f"{root}/{kind}") for kind in KINDS}
    kind_of = {folder: kind for kind, folder in reached.items() if folder}

    def of(kind: str) -> DataFrame:
        found = spark.read.options(pathGlobFilter="*.md", recursiveFileLookup=True).text(f"{root}/{kind}", wholetext=True)
        files = found.where(_directly_in(spark, F.col("_metadata.file_path"), f"{root}/{kind}")).select("value", F.col("_metadata.file_path").alias("p"))
        return named(F.lit(kind), _name(F.col("p")), F.col("value"), files)

    def named(kind: Column, name: Column, content: Column, files: DataFrame) -> DataFrame:
        path = F.concat(kind, F.lit("/"), name)
        return files.select(kind.alias("kind"), path.alias("path"), article_key(path).alias("key"), content.alias("content"))

    parts = [table_or_empty(lambda k=k: of(k), spark, schema) for k in KINDS if not reached[k]]
    if kind_of:
        names = _list_folders(spark, list(kind_of), ".md").select("folder", "name")
        count = names.count()
        tasks = max(1, min(count, max(spark.sparkContext.defaultParallelism, count // FILES)))
        files = names.repartition(tasks, "folder", "name").mapInArrow(_read_files, "folder string, name string, content binary")
        kind = F.element_at(F.create_map(*[F.lit(x) for both in kind_of.items() for x in both]), F.col("folder"))
        parts.append(named(kind, F.col("name"), F.col("content").cast("string"), files))
    return reduce(DataFrame.unionByName, parts)


def read_index(spark: SparkSession, path: str | None) -> DataFrame:
    """The index text, or the header of an empty one."""
    if path is None:
        return spark.createDataFrame([(EMPTY_INDEX,)], "content string")
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("content"))


def parse_hooks(lines: DataFrame, column: str = "raw") -> DataFrame:
    """Hook payloads (session_id, source, transcript_path): JSON, or JSON once lone backslashes are doubled.

    Payloads that stay malformed, and those without a path, go.
    """
    repaired = F.regexp_replace(F.col(column), LONE_BACKSLASH, r"\\\\")
    v = F.coalesce(F.try_parse_json(column), F.try_parse_json(repaired))
    rows = lines.withColumn("__v", v).where("__v is not null")
    rows = rows.where(F.schema_of_variant(F.try_variant_get("__v", "$.transcript_path", "variant")) == "STRING")
    get = lambda k: F.try_variant_get("__v", f"$.{k}", "string")
    out = rows.withColumns({"session_id": F.coalesce(get("session_id"), F.lit("unknown")), "source": F.coalesce(get("source"), F.lit("unknown")), "transcript_path": get("transcript_path")})
    return out.where(py_strip("transcript_path") != "").drop("__v")


def write_contexts(contexts: DataFrame, path: str, run: str = "0", once: bool = False) -> None:
    """A context table, in a part for each run; a run that is repeated replaces its own part, or with `once` changes
    nothing. Contexts with a skip_reason are not written."""
    if once and exists(contexts.sparkSession, f"{path}/run={run}"):
        return
    part = contexts.where("skip_reason is null").withColumn("run", F.lit(run))
    part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
