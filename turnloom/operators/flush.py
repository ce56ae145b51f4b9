"""Flush events and model responses to daily log entries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ordered_concat, py_strip
from ..shared import checkpoint
from ..ship import ship

SECONDS = 60

#: Fixed value.
LOG_HEADER = "# Daily Log: %s\n\n## Sessions\n\n## Memory Maintenance\n\n"

#: Section headers of a response. Fixed values.
SECTIONS = ("Context", "Key Exchanges", "Decisions Made", "Lessons Learned", "Action Items")


def _exits(us: np.ndarray, entries: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The last event kept for each event that may be kept first: upto[k] is the last of those with exit[k]."""
    at = np.arange(entries)
    follow = np.searchsorted(us, us[at] + step)
    while (follow < len(us)).any():
        at = np.where(follow < len(us), np.minimum(follow, len(us) - 1), at)
        follow = np.searchsorted(us, us[at] + step)
    ends = np.flatnonzero(np.append(at[1:] != at[:-1], True))
    return us[ends], us[at[ends]]


def _begins(table: pa.Table) -> np.ndarray:
    """Where a run of events of one session begins, and the end. A null session is one like others."""
    code = table["session_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate(([0], np.flatnonzero(code[1:] != code[:-1]) + 1, [len(code)]))


def _folded(us: np.ndarray, begins: np.ndarray, step: int, carried: int | None) -> np.ndarray:
    """The rows kept; carried: when the last one before was kept, if the first run is the end of that one's run."""
    first, last = begins[:-1], begins[1:] - 1
    long = us[last] - us[first] >= step  # else nothing but the first of a run is kept
    keep = [first[1:] if carried is not None else first]
    for k in sorted({*np.flatnonzero(long).tolist(), *([0] if carried is not None else [])}):
        run = us[first[k] : last[k] + 1]
        at = int(np.searchsorted(run, carried + step)) if k == 0 and carried is not None else int(np.searchsorted(run, run[0] + step))
        more = []
        while at < len(run):
            more.append(at + first[k])
            at = int(np.searchsorted(run, run[at] + step))
        keep.append(np.array(more, np.int64))
    return np.sort(np.concatenate(keep))


def dedup(events: DataFrame, seconds: int = SECONDS, mode: str = "per_session", ranges: int | None = None) -> DataFrame:
    """flush events (session_id, ts, source, event_id as tie-break): drops an event within `seconds` of the last kept one.

    per_session: each session by itself. single_slot: only the very last kept event counts, of whatever session. A skip
    does not refresh. Events without a time are kept; null is a session like others.

    Both modes are one fold, over the events in order of session and time, or of time alone: whatever stands before, the
    slot holds the session of the event before, so that an event is compared with its own run of one session. The
    order is cut into ranges (`ranges`, else as many as shuffles have partitions) that Spark samples; each range says what
    the slot is behind it, for whatever it is before it (one answer, or a step function where the range is one run); these
    summaries are composed, a row a range; then each range is folded by itself. So no task has more than a range, be all
    events of one session or of one hour.
    """
    order = {"per_session": ["session_id", "ts", "event_id", "source"], "single_slot": ["ts", "event_id", "session_id", "source"]}[mode]
    step, kept = seconds * 1_000_000, ["session_id", "ts", "event_id", "source"]
    ship(events.sparkSession)
    n = ranges or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    timed = events.where("ts is not null").select(*kept, F.unix_micros("ts").alias("us"))
    held = checkpoint(timed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))

    def table_of(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
        some = [b for b in batches if b.num_rows]
        return pa.Table.from_batches(some).combine_chunks() if some else None

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(batches)
        if table is None:
            return
        us, begins = table["us"].to_numpy(), _begins(table)
        if len(begins) == 2:  # what comes first is one of the events that are near the range's begin, or the next one
            upto, end = _exits(us, min(int(np.searchsorted(us, us[0] + step)) + 1, len(us)), step)
        else:
            run = us[begins[-2] :]
            upto, end = run[:1], run[_folded(run, np.array([0, len(run)]), step, None)[-1:]]
        ends = table.take(pa.array([0, table.num_rows - 1]))["session_id"].combine_chunks()
        longs = pa.list_(pa.int64())
        columns = [table["part"].combine_chunks()[:1], ends[:1], ends[1:], pa.array([len(begins) == 2]), pa.array([upto], longs), pa.array([end], longs)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "first", "last", "one", "upto", "exit"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, session, last = False, None, 0
        for b in batches:
            before = []
            for r in b.to_pylist():
                goes_on = known and r["first"] == session
                before.append(last if goes_on else None)
                if r["one"] and goes_on:  # nothing may be kept here: then the slot stays
                    k = int(np.searchsorted(r["upto"], last + step))
                    last = r["exit"][k] if k < len(r["exit"]) else last
                else:
                    last = r["exit"][0]
                known, session = True, r["last"]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(before, pa.int64())], names=["part", "before"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(batches)
        if table is not None:
            at = _folded(table["us"].to_numpy(), _begins(table), step, table["before"][0].as_py())
            yield from table.select(kept).take(pa.array(at)).combine_chunks().to_batches()

    kind = held.schema["session_id"].dataType.simpleString()
    summaries = held.mapInArrow(summary, f"part int, first {kind}, last {kind}, one boolean, upto array<long>, exit array<long>")
    before = checkpoint(summaries.repartition(1).sortWithinPartitions("part").mapInArrow(chain, "part int, before long"))  # a row a range
    out = held.join(F.broadcast(before), "part").select(*kept, "us", "before")
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select(kept).schema)
    return out.mapInArrow(fold, names).unionByName(events.where("ts is null").select(kept))


def route(responses: DataFrame, response_col: str = "response") -> DataFrame:
    """Adds section; drops responses that contain FLUSH_OK. An error goes to Memory Flush, even an empty one to Session."""
    r = F.coalesce(F.col(response_col), F.lit(""))
    return responses.where(~r.contains("FLUSH_OK")).withColumn("section", F.when(r.contains("FLUSH_ERROR"), "Memory Flush").otherwise("Session"))


def parse_sections(responses: DataFrame, id_col: str = "id", response_col: str = "response") -> DataFrame:
    """Items of responses in the five-section layout: (id, section, item_no, text). Context is one item, others are bullets."""
    names = "|".join(SECTIONS)
    blocks = F.regexp_extract_all(F.concat(response_col, F.lit("\n**")), F.lit(rf"(?s)\*\*({names}):\*\*(.*?)(?=\n\*\*)"), F.lit(0))
    each = responses.select(F.col(id_col), F.explode(blocks).alias("block"))
    name, rest = F.regexp_extract("block", rf"^\*\*({names}):\*\*", 1), F.regexp_replace("block", rf"^\*\*({names}):\*\*", "")
    items = F.when(name == "Context", F.array(py_strip(rest))).otherwise(F.transform(F.regexp_extract_all(rest, F.lit(r"(?m)^- (.*)$"), F.lit(1)), py_strip))
    out = each.select(id_col, name.alias("section"), F.posexplode(F.filter(items, lambda x: x != "")).alias("item_no", "text"))
    return out


def to_daily_entries(routed: DataFrame, ts_col: str = "ts", content_col: str = "response", tz: str = "UTC") -> DataFrame:
    local = F.from_utc_timestamp(F.col(ts_col), tz)
    return routed.select(F.to_date(local).alias("log_date"), local.alias("ts"), "section", F.col(content_col).alias("content"))


def render_entry() -> Column:
    return F.format_string("### %s (%s)\n\n%s\n\n", F.col("section"), F.date_format("ts", "HH:mm"), F.coalesce("content", F.lit("")))


def render_daily(entries: DataFrame, order: tuple[str, ...] = ("ts", "section", "content")) -> DataFrame:
    """Daily logs as text (file, log_date, content): a header, then the entries in order. A day is one row."""
    parts = entries.withColumn("__entry", render_entry())
    text = parts.groupBy("log_date").agg(ordered_concat(list(order), "__entry", "").alias("body"))
    head = F.format_string(LOG_HEADER, F.date_format("log_date", "yyyy-MM-dd"))
    return text.select(F.concat(F.date_format("log_date", "yyyy-MM-dd"), F.lit(".md")).alias("file"), "log_date", F.concat(head, "body").alias("content"))


def append_daily(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").partitionBy("log_date").parquet(path)
