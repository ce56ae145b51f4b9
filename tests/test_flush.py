import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.operators import flush as FL
from turnloom.operators import manifest as M
from turnloom.operators import model as MD

T0 = datetime(2024, 1, 1)


def events(spark, *rows):
    return spark.createDataFrame([(s, T0 + timedelta(seconds=t), "x", k) for k, (s, t) in enumerate(rows)], "session_id string, ts timestamp, source string, event_id long")


def kept(df):
    return sorted(r["event_id"] for r in df.collect())


def fold(rows, single=False):
    out, last = [], {}
    for k, (s, t) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        if s in last and t - last[s] < 60:
            continue
        if single:
            last = {}
        last[s] = t
        out.append(k)
    return sorted(out)


def test_dedup_cases(spark):
    assert kept(FL.dedup(events(spark, ("a", 0), ("a", 40), ("a", 80)))) == [0, 2]
    assert kept(FL.dedup(events(spark, ("a", 0), ("a", 60)))) == [0, 1]
    assert kept(FL.dedup(events(spark, ("A", 0), ("B", 10), ("A", 20)), mode="single_slot")) == [0, 1, 2]
    assert kept(FL.dedup(events(spark).limit(0))) == []


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(3400, 3900)), min_size=1, max_size=25), st.integers(1, 9))
def test_dedup_is_the_greedy_fold(spark, rows, ranges):
    df = events(spark, *rows)
    assert kept(FL.dedup(df, ranges=ranges)) == fold(rows)
    assert kept(FL.dedup(df, mode="single_slot", ranges=ranges)) == fold(rows, single=True)


def test_dedup_of_a_busy_session(spark):
    rows = [("a", t) for t in range(3000, 15000, 7)] + [("b", t) for t in range(3590, 3660)] + [("b", 7199), ("b", 7250), ("b", 7259)] + [(None, 0), (None, 59), (None, 60)]
    df = events(spark, *rows)
    assert kept(FL.dedup(df)) == fold(rows)
    assert kept(FL.dedup(df.where("session_id = 'a'"), mode="single_slot")) == fold([r for r in rows if r[0] == "a"])


@pytest.mark.parametrize("seed", range(3))
def test_one_hour_of_everything(spark, seed):
    """All events within an hour, long runs of a session across many ranges, several events at a time."""
    rng, rows, t = random.Random(seed), [], 0.0
    while t < 3500:
        who = rng.choice(["a", "a", "b", "c", None])
        for _ in range(rng.choice([1, 1, 2, 300])):
            t += rng.choice([0, 0, 0.5, 1, 7, 29.999999, 60]) / (1 + 5 * (rng.random() < 0.8))
            rows.append((who, t))
    rows = [(s, round(x, 6)) for s, x in rows if x < 3600]
    df = events(spark, *rows)
    for ranges in (1, 5, 40):
        assert kept(FL.dedup(df, ranges=ranges)) == fold(rows)
        assert kept(FL.dedup(df, mode="single_slot", ranges=ranges)) == fold(rows, single=True)


def test_events_without_a_time_are_kept(spark):
    df = events(spark, ("a", 0), ("a", 1)).unionByName(spark.sql("select 'a' session_id, cast(null as timestamp) ts, 'x' source, 9L event_id"))
    assert kept(FL.dedup(df)) == kept(FL.dedup(df, mode="single_slot")) == [0, 9]


def test_no_task_has_more_than_a_range(spark):
    """One session within a few minutes is dealt out evenly."""
    df = spark.range(40_000).select(F.lit("a").alias("session_id"), F.timestamp_micros(F.col("id") * 5000).alias("ts"), F.lit("x").alias("source"), F.col("id").alias("event_id"))
    for mode in ("per_session", "single_slot"):
        assert kept(FL.dedup(df, mode=mode, ranges=8)) == [0, 12_000, 24_000, 36_000]
    sizes = [r["count"] for r in df.repartitionByRange(8, "session_id", "ts", "event_id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 10_000


def test_route(spark):
    df = spark.createDataFrame([(1, "a FLUSH_ERROR FLUSH_OK"), (2, "FLUSH_ERROR: x"), (3, ""), (4, "text"), (5, None)], "id int, response string")
    assert {r["id"]: r["section"] for r in FL.route(df).collect()} == {2: "Memory Flush", 3: "Session", 4: "Session", 5: "Session"}


def test_sections(spark):
    text = "**Context:** c\n\n**Key Exchanges:**\n- a\n- b\n\n**Decisions Made:**\n\n**Lessons Learned:**\n- l\n\n**Action Items:**\n- z"
    rows = FL.parse_sections(spark.createDataFrame([(1, text)], "id int, response string")).collect()
    assert [(r["section"], r["item_no"], r["text"]) for r in rows] == [("Context", 0, "c"), ("Key Exchanges", 0, "a"), ("Key Exchanges", 1, "b"), ("Lessons Learned", 0, "l"), ("Action Items", 0, "z")]


def test_render_and_append(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1, 2, 9, 5), "Session", "x"), (datetime(2024, 1, 2, 8, 0), "Memory Flush", None)], "ts timestamp, section string, response string")
    entries = FL.to_daily_entries(df)
    row = FL.render_daily(entries).first()
    assert row["file"] == "2024-01-02.md"
    assert row["content"] == "# Daily Log: 2024-01-02\n\n## Sessions\n\n## Memory Maintenance\n\n### Memory Flush (08:00)\n\n\n\n### Session (09:05)\n\nx\n\n"
    FL.append_daily(entries, str(tmp_path / "d"))
    FL.append_daily(entries, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).where("log_date = date'2024-01-02'").count() == 4


def test_manifest(spark):
    logs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "file string, hash string")
    manifest = spark.createDataFrame([("a", "1", T0, None), ("b", "old", T0, None), ("c", None, T0, None)], M.SCHEMA)
    files = lambda df: sorted(r["file"] for r in df.collect())
    assert files(M.pending(logs, manifest)) == ["b", "c", "d"]
    assert files(M.pending(logs, manifest, force=True)) == ["a", "b", "c", "d"]
    assert files(M.pending(logs, manifest, only="a")) == ["a"]
    assert files(M.pending(logs, M.read_manifest(spark, None))) == ["a", "b", "c", "d"]
    runs = spark.createDataFrame([("b", "2", T0 + timedelta(1), None, None), ("d", "4", T0, None, "failed")], M.SCHEMA + ", error string")
    assert {r["file"]: r["hash"] for r in M.upsert(manifest, runs).collect()} == {"a": "1", "b": "2", "c": None}


def test_end_of_day(spark):
    logs = spark.createDataFrame([("2024-01-01.md", "1"), ("2024-01-02.md", "2")], "file string, hash string")
    manifest = spark.createDataFrame([("2024-01-01.md", "1", T0, None), ("2024-01-03.md", "9", T0, None)], M.SCHEMA)
    at = spark.createDataFrame([(datetime(2024, 1, d, h),) for d, h in ((1, 19), (2, 17), (2, 18), (3, 20), (4, 3))], "ts timestamp")
    assert {(r["file"], r["reason"]) for r in M.end_of_day(at, logs, manifest).collect()} == {("2024-01-02.md", "not_compiled"), ("2024-01-03.md", "changed")}


def test_call_model(spark):
    def fn(p):
        if p == "bad":
            raise ValueError("no")
        return p.upper()

    out = MD.call_model(spark.createDataFrame([("a",), ("bad",)], "p string"), "p", fn)
    assert {(r["p"], r["response"], r["error"]) for r in out.collect()} == {("a", "A", None), ("bad", None, "ValueError: no")}
    assert {r["response"] for r in MD.as_flush_response(out).collect()} == {"A", "FLUSH_ERROR: ValueError: no"}
    assert MD.as_system_issue(out).first()["file"] == "(system)"
