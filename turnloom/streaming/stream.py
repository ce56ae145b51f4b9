"""The event-driven parts as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.flush import dedup
from ..operators.manifest import pending
from ..shared import broadcast_if_small, checkpoint
from ..ship import ship
from ..sources.files import parse_hooks
from ..sources.snapshots import commit, read_snapshot, versions


def hook_stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """Hook payloads from text files that arrive in path, a payload a line; a batch takes `files` files at most."""
    return parse_hooks(spark.readStream.option("maxFilesPerTrigger", files).text(path).withColumnRenamed("value", "raw"))


#: A missing time as numpy has it.
NO_TIME = np.iinfo(np.int64).min


#: Groups of sessions that have a state each in dedup_stream. A stream that goes on must keep it.
BUCKETS = 1000


def dedup_stream(events: DataFrame, seconds: int = 60, watermark: str = "1 hour") -> DataFrame:
    """Per session, drops an event within `seconds` of the last kept one. events (session_id, ts, source, event_id).

    Sessions are dealt out to BUCKETS by their hash, as a call for each session would cost more than its rows. A bucket's rows
    of a batch are one frame; dedup_batches has no such limit. State is one time a session, dropped once the watermark has
    passed it by `seconds`. Within a batch events are ordered by time and id; events later than the watermark are dropped and
    counted in the query's progress, those without a time are kept.
    """
    ship(events.sparkSession)
    step = seconds * 1_000_000

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts, now = list(batches), state.getCurrentWatermarkMs()
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        us = rows["ts"].to_numpy("datetime64[us]").view("int64")
        code, names = pd.factorize(rows["session_id"], use_na_sentinel=False)
        order = np.lexsort((rows["event_id"].to_numpy(), us, code))
        keep, order = [order[us[order] == NO_TIME]], order[us[order] != NO_TIME]
        us, code = us[order], code[order]
        begins = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist()] if len(us) else []
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        for begin, end in zip(begins, [*begins[1:], len(us)]):
            name, run = names[code[begin]], us[begin:end]
            name = None if pd.isna(name) else name
            at, picked = int(np.searchsorted(run, known[name] + step)) if name in known else 0, []
            while at < len(run):  # from each kept event to the next one that is late enough
                picked.append(begin + at)
                known[name] = int(run[at])
                at = int(np.searchsorted(run, run[at] + step))
            keep.append(order[np.array(picked, np.int64)])
        known = {name: last for name, last in known.items() if last + step >= now * 1000}
        if known:
            state.update((list(known), list(known.values())))
            state.setTimeoutTimestamp(max(max(known.values()) // 1000 + seconds * 1000, now) + 1)
        elif state.exists:
            state.remove()
        yield rows.take(np.concatenate(keep))[["session_id", "ts", "source", "event_id"]]

    schema = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("source", T.StringType()), T.StructField("event_id", T.LongType())])
    state = T.StructType([T.StructField("sessions", T.ArrayType(T.StringType())), T.StructField("last", T.ArrayType(T.LongType()))])
    dealt = events.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)))
    return dealt.withWatermark("ts", watermark).groupBy("bucket").applyInPandasWithState(fold, schema, state, "append", GroupStateTimeout.EventTimeTimeout)


#: What dedup_batches knows of each session: when its last event was kept; and, marked, the latest time of all events.
STATE = "session_id string, last timestamp, mark boolean"


def dedup_batches(events: DataFrame, path: str, state: str, checkpoint_folder: str, seconds: int = 60, watermark: int = 3600) -> StreamingQuery:
    """dedup_stream for sessions of any size: each batch is deduplicated by flush.dedup, whose tasks have a range of the
    events at most, be they all of one session, and written to a part of path (session_id, ts, source, event_id, batch).

    state is a table with versions, one a batch: the last kept time of each session, until the latest event is `watermark`
    seconds and `seconds` beyond it. Events that are later than that are dropped; those without a time are kept. A batch
    that is run again replaces its part, and one that the state has changes nothing. Within a batch events are ordered by
    time and id.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = versions(spark, state)
        if known and known[-1] > batch_id:
            return
        held = checkpoint(batch.select("session_id", "ts", "source", "event_id"))
        before = checkpoint(read_snapshot(spark, state, STATE, known[-1] if known else None))
        marks = [t for t in (before.where("mark").agg(F.max("last")).first()[0], held.agg(F.max("ts")).first()[0]) if t is not None]
        bound = lambda t: t - timedelta(seconds=watermark)
        old = before.where("not mark").select(F.col("session_id").alias("__s"), "last")
        late = F.lit(False) if before.isEmpty() or len(marks) < 2 else F.coalesce(F.col("ts") < F.lit(bound(marks[0])), F.lit(False))
        joined = held.where(~late).join(broadcast_if_small(old), F.col("session_id").eqNullSafe(F.col("__s")), "left")
        fresh = joined.where(F.col("last").isNull() | F.col("ts").isNull() | (F.unix_micros("ts") - F.unix_micros("last") >= seconds * 1_000_000))
        kept = checkpoint(dedup(fresh.select("session_id", "ts", "source", "event_id"), seconds))
        kept.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        every = old.select(F.col("__s").alias("session_id"), "last").unionByName(kept.where("ts is not null").select("session_id", F.col("ts").alias("last")))
        last = every.groupBy("session_id").agg(F.max("last").alias("last"))
        if marks:
            last = last.where(F.col("last") >= F.lit(bound(max(marks)) - timedelta(seconds=seconds)))
            mark = spark.createDataFrame([(None, max(marks))], "session_id string, last timestamp")
            last = last.withColumn("mark", F.lit(False)).unionByName(mark.withColumn("mark", F.lit(True)))
        commit(spark, state, STATE, lambda _: last)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_folder).trigger(availableNow=True).start()


def append_daily(entries: DataFrame, path: str, checkpoint_folder: str, query: str = "daily") -> StreamingQuery:
    """Appends a stream of daily entries to partitions by day. A batch that is run again replaces its own rows."""

    def put(batch: DataFrame, batch_id: int) -> None:
        part = batch.withColumn("query", F.lit(query)).withColumn("batch_id", F.lit(batch_id))
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("query", "batch_id", "log_date").parquet(path)

    return entries.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint_folder).trigger(availableNow=True).start()


def incremental_run(logs: DataFrame, manifest: Callable[[], DataFrame], compile_batch: Callable[[DataFrame, int], None], checkpoint_folder: str) -> StreamingQuery:
    """Runs compile_batch over what is new or changed against the manifest as it is then, once per arrival of logs."""

    def step(batch: DataFrame, batch_id: int) -> None:
        compile_batch(pending(batch, manifest()), batch_id)

    return logs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_folder).trigger(availableNow=True).start()
