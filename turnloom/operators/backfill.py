"""History as one batch: transcripts of past sessions to daily entries, by the same steps as live ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import broadcast_if_small, checkpoint, forget, work_folder
from ..sources.snapshots import commit, read_snapshot, versions
from . import flush, model, turns


def _contexts(main: DataFrame, sub: DataFrame | None, max_turns: int = turns.MAX_TURNS, max_chars: int = turns.MAX_CHARS, min_turns: int = turns.MIN_TURNS["backfill"]) -> DataFrame:
    """(session_id, turn_count, skip_reason, context) of sessions that have turns."""
    every = turns.attach_subagents(main, sub) if sub is not None else main
    return turns.gate(turns.build_contexts(every, max_turns, max_chars), min_turns).select("session_id", "turn_count", "skip_reason", "context")


def _answered(timed: DataFrame, fn: Callable[[str], str], memo: str | None, at_a_time: int | None) -> DataFrame:
    """timed (session_id, ts, turn_count, skip_reason, context) to the rows of backfill."""
    asked = timed.where("skip_reason is null").withColumn("prompt", model.extract_prompt()).select("session_id", "ts", "turn_count", "skip_reason", "prompt")
    called = model.call_once(asked, "prompt", fn, memo, at_a_time) if memo else model.call_model(asked.repartition(at_a_time) if at_a_time else asked, "prompt", fn)
    said = checkpoint(model.as_flush_response(called).drop("prompt"))
    routed = flush.route(said.select("session_id", "ts", "turn_count", "skip_reason", "response"))
    none = said.where(F.coalesce("response", F.lit("")).contains("FLUSH_OK")).select("session_id", "ts", "turn_count", "skip_reason")
    skipped = timed.where("skip_reason is not null").select("session_id", "ts", "turn_count", "skip_reason")
    empty = lambda df: df.withColumns({"section": F.lit(None).cast("string"), "response": F.lit(None).cast("string")})
    return routed.select("session_id", "ts", "turn_count", "skip_reason", "section", "response").unionByName(empty(none)).unionByName(empty(skipped))


def backfill(sessions: DataFrame, main: DataFrame, sub: DataFrame | None, fn: Callable[[str], str], max_turns: int = turns.MAX_TURNS, max_chars: int = turns.MAX_CHARS, min_turns: int = turns.MIN_TURNS["backfill"], memo: str | None = None, at_a_time: int | None = None) -> DataFrame:
    """sessions (session_id, mtime), main and sub: turns of their transcripts and of their subagents'.

    Returns a row for each session that has turns: session_id, ts (its transcript's time), turn_count, skip_reason, section
    and response, which are null where the session is skipped or fn finds nothing worth keeping. Sessions do not wait
    for each other. Entries for the logs are flush.to_daily_entries of the rows with a section.
    """
    timed = _contexts(main, sub, max_turns, max_chars, min_turns).join(sessions.select("session_id", F.col("mtime").alias("ts")), "session_id")
    return _answered(timed, fn, memo, at_a_time)


#: Sessions that are done and written together.
GROUP = 1000

#: What is known of sessions that are done.
DONE = "session_id string, part long"


#: Sessions with their contexts, as they are dealt out; turn_count is null where a session has no turns.
READY = "session_id string, ts timestamp, turn_count int, skip_reason string, context string, group int"


def resume_backfill(sessions: DataFrame, main: DataFrame, sub: DataFrame | None, fn: Callable[[str], str], path: str, group: int = GROUP, memo: str | None = None, at_a_time: int | None = None, **limits: int) -> DataFrame:
    """backfill() of a long history that may be broken off and begun again: sessions in groups of about `group`, the oldest
    first, each written to path before the next one is begun. Returns the rows of all groups, those of earlier runs too.

    path/ledger, a table with versions, has the sessions that are done; they are left out first. A group's rows are written
    to a part of its own, which counts once the ledger has it; so a run that breaks in a group does only that group again,
    and with a memo (memo, at_a_time and limits: as of backfill) puts no prompt twice. Sessions that have no turns are done as
    well; one that is done stays so if its transcript grows.

    Turns are read once for all groups: the contexts of the sessions that are left are written by group first, and a group
    reads its own part of them.
    """
    spark, ledger = sessions.sparkSession, f"{path}/ledger"
    own = sessions.where("session_id is not null").groupBy("session_id").agg(F.min("mtime").alias("mtime"))
    left = checkpoint(own.join(read_snapshot(spark, ledger, DONE).select("session_id"), "session_id", "left_anti"))
    groups = -(-left.count() // group)
    if groups:
        # dealt out by time: a sorted range each, numbered in order
        dealt = checkpoint(left.repartitionByRange(groups, "mtime", "session_id").withColumn("group", F.spark_partition_id()))
        few = broadcast_if_small(dealt.select("session_id"))
        mine = lambda t: t.join(few, "session_id", "left_semi")
        ready = work_folder(spark, "backfill-groups")
        timed = dealt.join(_contexts(mine(main), mine(sub) if sub is not None else None, **limits), "session_id", "left")
        timed.select("session_id", F.col("mtime").alias("ts"), "turn_count", "skip_reason", "context", "group").repartition(groups, "group").write.partitionBy("group").parquet(ready)
        table = spark.read.schema(READY).parquet(ready)
        for k in sorted(r["group"] for r in dealt.select("group").distinct().collect()):  # a row a group
            some = table.where(F.col("group") == k).drop("group")
            part = (versions(spark, ledger) or [0])[-1] + 1
            _answered(some.where("turn_count is not null"), fn, memo, at_a_time).write.mode("overwrite").parquet(f"{path}/parts/part={part}")
            commit(spark, ledger, DONE, lambda old, some=some, part=part: old.unionByName(some.select("session_id", F.lit(part).cast("long").alias("part"))))
        forget(spark, ready)
    done = [r["part"] for r in read_snapshot(spark, ledger, DONE).select("part").distinct().collect()]  # a row a group
    read = [f"{path}/parts/part={n}" for n in sorted(done)]
    kind = "session_id string, ts timestamp, turn_count int, skip_reason string, section string, response string"
    return spark.read.schema(kind).parquet(*read) if read else spark.createDataFrame([], kind)
