"""Incremental compilation: which logs are new or changed, and the record of what was compiled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import after_hours
from ..shared import exists, table_or_empty
from ..sources.snapshots import commit, read_snapshot

SCHEMA = "file string, hash string, compiled_at timestamp, cost_usd decimal(18,6)"


def read_manifest(spark: SparkSession, path: str | None, version: int | None = None) -> DataFrame:
    """The manifest table, or an empty one where there is none yet: its latest version or the one asked for, where
    write_manifest keeps it, else the Parquet table at path."""
    if path and (version is not None or exists(spark, f"{path}/versions")):
        return read_snapshot(spark, path, SCHEMA, version)
    return table_or_empty(lambda: spark.read.schema(SCHEMA).parquet(path), spark, SCHEMA) if path else spark.createDataFrame([], SCHEMA)


def pending(logs: DataFrame, manifest: DataFrame, force: bool = False, only: str | None = None) -> DataFrame:
    """Logs without a record, or whose hash differs from it. force: all; only: one file."""
    if only is not None:
        return logs.where(F.col("file") == only)
    if force:
        return logs
    known = manifest.select("file", F.col("hash").alias("__hash"), F.lit(True).alias("__known"))
    return logs.join(known, "file", "left").where(F.col("__known").isNull() | ~F.col("__hash").eqNullSafe(F.col("hash"))).drop("__hash", "__known")


def upsert(manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds records of runs without an error; the latest record of a file wins."""
    ok = runs.where(F.col("error").isNull()) if "error" in runs.columns else runs
    every = manifest.select("file", "hash", "compiled_at", "cost_usd").unionByName(ok.select("file", "hash", "compiled_at", "cost_usd"))
    latest = Window.partitionBy("file").orderBy(F.desc("compiled_at"), F.desc("hash"))
    return every.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")


def write_manifest(runs: DataFrame, path: str) -> int:
    """Commits the records of runs (upsert) to the manifest kept at path, and returns the new version. Writers that run at
    the same time lose nothing, and readers see a version before or after. runs is computed once for each attempt."""
    return commit(runs.sparkSession, path, SCHEMA, lambda manifest: upsert(manifest, runs))


def end_of_day(triggers: DataFrame, logs: DataFrame, manifest: DataFrame, tz: str = "UTC", hour: int = 18) -> DataFrame:
    """triggers (ts): dates on which a trigger after hours finds its day's log not compiled or changed since.

    A log in the manifest whose file is missing triggers, too.
    """
    late = triggers.where(after_hours("ts", tz, hour)).select(F.to_date(F.from_utc_timestamp("ts", tz)).alias("log_date")).distinct()
    named = late.withColumn("file", F.concat(F.date_format("log_date", "yyyy-MM-dd"), F.lit(".md")))
    joined = named.join(logs.select("file", F.col("hash").alias("now")), "file", "left").join(manifest.select("file", F.col("hash").alias("then"), F.lit(True).alias("known")), "file", "left")
    why: Column = F.when(F.col("known").isNull(), "not_compiled").when(~F.col("now").eqNullSafe(F.col("then")), "changed")
    return joined.select("log_date", "file", why.alias("reason")).where("reason is not null")


def cost_rollup(runs: DataFrame, by: str = "run_id") -> DataFrame:
    """Cost and count by run, and in all (a null run)."""
    return runs.rollup(by).agg(F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("n"))
