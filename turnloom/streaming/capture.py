"""From hook payloads to session contexts: what happens when a session ends or is about to be compacted."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import turns as TU
from ..shared import checkpoint, exists
from ..sources.files import plain_path, read_named_transcripts, write_contexts


def capture(hooks: DataFrame, event: str = "session_end", max_turns: int = TU.MAX_TURNS, max_chars: int = TU.MAX_CHARS, min_turns: int | None = None) -> DataFrame:
    """hooks (session_id, source, transcript_path), a bounded batch: the contexts of the sessions that they name.

    Only the transcripts that the batch names, and those of their subagents, are listed and read; their paths go through
    the driver, as the paths of any read do. Returns session_id, source, transcript_path (plain_path), context, turn_count,
    n_chars, truncated, skip_reason: a row for each session and transcript, however often it is named. skip_reason is
    missing where the file is not there or has no turns, else as of gate() with the least turns of the event (session_end,
    pre_compact or backfill).
    """
    least = TU.MIN_TURNS[event] if min_turns is None else min_turns
    named = hooks.select("session_id", "source", "transcript_path").where("transcript_path is not null")
    named = checkpoint(named.groupBy("session_id", plain_path(F.trim("transcript_path")).alias("transcript_path")).agg(F.min("source").alias("source"), F.min(F.trim("transcript_path")).alias("as_named")))
    paths = sorted({r["as_named"] for r in named.select("as_named").distinct().toLocalIterator()})
    spark = hooks.sparkSession
    main, sub = (TU.parse_turns(read_named_transcripts(spark, paths, s)) for s in (False, True))
    found = TU.build_contexts(TU.attach_subagents(main, sub), max_turns, max_chars).withColumnRenamed("session_id", "transcript_path")
    whole = TU.gate(named.drop("as_named").join(found, "transcript_path", "left"), least)
    reason = F.when(F.col("turn_count").isNull(), "missing").otherwise(F.col("skip_reason"))
    return whole.select("session_id", "source", "transcript_path", "context", "turn_count", "n_chars", "truncated", reason.alias("skip_reason"))


def capture_stream(hooks: DataFrame, path: str, checkpoint_folder: str, query: str = "capture", **limits: object) -> StreamingQuery:
    """Runs capture() over a stream of hooks (as of hook_stream, whose `files` bounds a batch) and writes the contexts that
    pass the gate to path, once for each session, transcript and batch: a batch that is run again, after a failure or by
    another run of the same query name, finds its part there and changes nothing. limits: of capture()."""
    if not re.fullmatch(r"[\w.-]+", query):
        raise ValueError("a query's name has letters, digits, '.', '_' and '-' only")

    def step(batch: DataFrame, batch_id: int) -> None:
        run = f"{query}-{batch_id}"
        if not exists(batch.sparkSession, f"{path}/run={run}"):  # before any transcript is looked up
            write_contexts(capture(batch, **limits), path, run, once=True)

    return hooks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_folder).trigger(availableNow=True).start()
