import hashlib
import json
import random
import os
from datetime import datetime, timedelta

import pytest

from turnloom.operators import flush as FL
from turnloom.sources import changes as CH
from turnloom.sources import snapshots as S
from turnloom.sources.files import read_named_transcripts
from turnloom.streaming import capture as CA
from turnloom.streaming import stream as ST

T0 = datetime(2024, 1, 1)

#: Content hash of "y".
M_HASH = hashlib.sha256(b"y").hexdigest()[:16]


def test_dedup_over_several_batches_equals_batch(spark, tmp_path):
    rows = [("a", 0), ("a", 40), ("a", 80), ("b", 10), ("b", 75), ("a", 141), ("b", 100)]
    schema = "session_id string, ts timestamp, source string, event_id long"
    df = spark.createDataFrame([(s, T0 + timedelta(seconds=t), "x", k) for k, (s, t) in enumerate(rows)], schema)
    df.where("event_id < 4").coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: ST.dedup_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    run()
    df.where("event_id >= 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r["event_id"] for r in FL.dedup(df).collect())


def test_dedup_of_a_stream_with_many_sessions(spark, tmp_path):
    """Over three batches, with a null session, repeated times, old sessions and events without a time; sessions share states."""
    p, schema, rng = str(tmp_path), "session_id string, ts timestamp, source string, event_id long", random.Random(3)
    rows = [(rng.choice([None, *map(str, range(2500))]), None if rng.random() < 0.01 else T0 + timedelta(seconds=k // 4000 * 2400 + rng.randrange(600)), "x", k) for k in range(12_000)]
    for k in range(0, 12_000, 4000):
        spark.createDataFrame(rows[k : k + 4000], schema).coalesce(1).write.mode("append").parquet(f"{p}/in")
        out = ST.dedup_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{p}/in"))
        query = out.writeStream.format("parquet").option("path", f"{p}/out").option("checkpointLocation", f"{p}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        assert max(o["numRowsTotal"] for r in query.recentProgress for o in r["stateOperators"]) <= ST.BUCKETS
    got = sorted(r["event_id"] for r in spark.read.parquet(f"{p}/out").collect())
    assert got == sorted(r["event_id"] for r in FL.dedup(spark.createDataFrame(rows, schema)).collect())


def test_dedup_of_batches_with_a_kept_state(spark, tmp_path):
    """Three batches and a replay, with a busy session, a null one, late events and ones without a time."""
    p, schema = str(tmp_path), "session_id string, ts timestamp, source string, event_id long"
    at = lambda t: None if t is None else T0 + timedelta(seconds=t)
    batches = [[("a", k * 0.01) for k in range(9000)] + [(None, 5), (None, 30), ("b", 7)], [("a", 91), ("a", 120), ("a", 125.0), (None, 66), ("b", None), ("c", 9000)], [("a", 130), ("c", 9030), ("c", 9061), ("a", 9000)]]
    n, rows = 0, []
    run = lambda state: ST.dedup_batches(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{p}/in"), f"{p}/out", f"{p}/last", f"{p}/{state}").awaitTermination()
    for batch in batches:
        new = [(s, at(t), "x", n + k) for k, (s, t) in enumerate(batch)]
        n, rows = n + len(batch), rows + new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(f"{p}/in")
        run("progress")
    got = sorted(r["event_id"] for r in spark.read.parquet(f"{p}/out").collect())
    late = next(r[3] for r in rows if r[1] == at(130))  # behind the watermark of 9000 - 3600
    want = FL.dedup(spark.createDataFrame(rows, schema).where(f"event_id <> {late}"))
    assert got == sorted(r["event_id"] for r in want.collect()) and late not in got
    state = {r["session_id"] for r in S.read_snapshot(spark, f"{p}/last", ST.STATE).where("not mark").collect()}
    assert state == {"a", "c"} and S.versions(spark, f"{p}/last") == [1, 2, 3]  # b and the null session are long over
    run("other")
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{p}/out").collect()) == got and S.versions(spark, f"{p}/last") == [1, 2, 3]


def test_hook_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"session_id": "s", "transcript_path": "/p"}\nbad\n')
    q = ST.hook_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("hooks").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["session_id"], r["source"]) for r in spark.table("hooks").collect()] == [("s", "unknown")]


def test_append_daily_twice(spark, tmp_path):
    rows = spark.createDataFrame([(T0, "Session", "x")], "ts timestamp, section string, response string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = FL.to_daily_entries(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    for _ in range(2):  # the second run finds nothing new
        ST.append_daily(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def said(*texts):
    return "\n".join(json.dumps({"message": {"role": "user", "content": t}}) for t in texts) + "\n"


def test_capture_reads_only_what_is_named(spark, tmp_path):
    odd = "a,b {c}[1]+%20 é*.jsonl"
    root = tmp_path / "x y"
    (root / "s1" / "subagents").mkdir(parents=True)
    (root / odd).write_text(said("one"))
    (root / "s1.jsonl").write_text(said("two", "three"))
    (root / "s1" / "subagents" / "h.jsonl").write_text(said("four"))
    (root / "s2.jsonl").write_text(said("never read"))
    (root / "empty.jsonl").write_text("\nnoise\n")
    paths = [f"{root}/{odd}", f"file:{root}/s1.jsonl", f"{root}//empty.jsonl", f"{root}/gone.jsonl", "/nowhere/x.jsonl", "C:\\x", "", "rel/x"]
    hooks = spark.createDataFrame([(f"i{k}", "e", p) for k, p in enumerate(paths)] + [("i1", "d", paths[1]), ("i9", "e", paths[1]), ("i8", "e", None)], "session_id string, source string, transcript_path string")
    got = {r["session_id"]: r for r in CA.capture(hooks).collect()}
    assert sorted(got) == [*(f"i{k}" for k in range(8)), "i9"]
    assert got["i0"]["context"] == "**User:** one\n" and got["i1"]["source"] == "d"
    assert got["i1"]["context"] == got["i9"]["context"] == "**User:** two\n\n**User:** three\n\n**[Subagent: h]**\n\n**User:** four\n"
    assert {k: r["skip_reason"] for k, r in got.items()} == {f"i{k}": "missing" for k in range(2, 8)} | {"i0": None, "i1": None, "i9": None}
    early = {r["session_id"]: r["skip_reason"] for r in CA.capture(hooks, "pre_compact").collect()}
    assert early["i0"] == early["i1"] == "too_few_turns"
    files = {f for s in (False, True) for f in read_named_transcripts(spark, paths, s).inputFiles()}
    assert len(files) == 4 and not any("s2" in f for f in files)
    assert CA.capture(hooks.limit(0)).count() == 0


def test_capture_stream_is_idempotent(spark, tmp_path):
    root, put = str(tmp_path), lambda name, *ids: (tmp_path / "in" / name).write_text("\n".join(json.dumps({"session_id": i, "transcript_path": f"{tmp_path}/{i}.jsonl"}) for i in ids))
    (tmp_path / "in").mkdir()
    for i in "ab":
        (tmp_path / f"{i}.jsonl").write_text(said(f"hello {i}"))
    put("1", "a", "a", "gone")
    run = lambda state: CA.capture_stream(ST.hook_stream(spark, f"{root}/in"), f"{root}/out", f"{root}/{state}").awaitTermination()
    read = lambda: sorted((r["session_id"], r["context"]) for r in spark.read.parquet(f"{root}/out").collect())
    run("state")
    first = read()
    assert first == [("a", "**User:** hello a\n")]
    (tmp_path / "a.jsonl").write_text(said("changed since"))
    run("other-state")  # the same batch again, as after a lost checkpoint
    run("state")
    assert read() == first
    put("2", "b", "a")
    run("state")
    assert read() == sorted([*first, ("a", "**User:** changed since\n"), ("b", "**User:** hello b\n")])


def test_a_captured_batch_is_not_looked_up_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    (tmp_path / "in").mkdir()
    (tmp_path / "a.jsonl").write_text(said("hello"))
    (tmp_path / "in" / "1").write_text(json.dumps({"session_id": "a", "transcript_path": f"{root}/a.jsonl"}))
    asked, capture = [], CA.capture
    monkeypatch.setattr(CA, "capture", lambda *a, **k: asked.append(1) or capture(*a, **k))
    for state in ("state", "other-state"):
        CA.capture_stream(ST.hook_stream(spark, f"{root}/in"), f"{root}/out", f"{root}/{state}").awaitTermination()
    assert len(asked) == 1 and spark.read.parquet(f"{root}/out").count() == 1


def test_changed_files(spark, tmp_path):
    logs, ledger, got = tmp_path / "daily", str(tmp_path / "ledger"), []
    step = lambda batch, number: got.append((number, sorted((r["file"], r["content"]) for r in batch.collect())))
    run = lambda **k: CH.run_changes(spark, str(logs), ledger, step, **k)
    assert run() is None and got == []  # no folder yet
    logs.mkdir()
    for name in ("a.md", "b [1],{x} é.md", "c.txt"):
        (logs / name).write_text("one")
    assert run() == 1 and run() is None
    (logs / "a.md").write_text("one and more")
    (logs / "d.md").write_text("new")
    (logs / "none.md").write_text("")  # not read before it has content
    assert run() == 2
    os.utime(logs / "a.md", (1, 1))  # another time, the same text
    assert run() is None and run() is None
    assert got == [(1, [("a.md", "one"), ("b [1],{x} é.md", "one")]), (2, [("a.md", "one and more"), ("d.md", "new")])]
    (logs / "a.md").write_text("eno and more")
    os.utime(logs / "a.md", (1, 1))  # the same time and size, another text
    assert run() is None and run(by_content=True) is not None and got[-1][1] == [("a.md", "eno and more")]

    def broken(batch, number):
        raise RuntimeError("lost")

    (logs / "d.md").write_text("x")
    with pytest.raises(RuntimeError):
        CH.run_changes(spark, str(logs), ledger, broken)
    (logs / "d.md").unlink()
    (logs / "none.md").unlink()
    (logs / "e.md").write_text("y")
    assert run() is not None and got[-1][1] == [("e.md", "y")]  # what went meanwhile is no file any more
    manifest = spark.createDataFrame([("e.md", M_HASH)], "file string, hash string")
    seen = []
    CH.incremental_logs(spark, str(logs), str(tmp_path / "other"), lambda: manifest, lambda batch, n: seen.extend(sorted(r["file"] for r in batch.collect())))
    assert seen == ["a.md", "b [1],{x} é.md"]
