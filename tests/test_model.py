"""Calls of the caller's function: once a prompt, and a history that is broken off."""

from datetime import datetime
from pathlib import Path

import pytest

from turnloom.operators import model as MD
from turnloom.operators.backfill import backfill, resume_backfill


def counting(folder):
    """A stand-in that leaves a line for each call, in a file for each prompt; some prompts fail at first."""

    def fn(prompt):
        if prompt is None:
            return "nothing"
        file = Path(folder) / f"{abs(hash(prompt))}-{len(prompt)}"
        with file.open("a") as f:
            f.write("x\n")
        if "bad" in prompt and file.stat().st_size < 4:
            raise ValueError(prompt[:10])
        return prompt.upper()

    return fn


def calls(folder):
    return sorted(len(p.read_text().splitlines()) for p in Path(folder).iterdir())


@pytest.mark.parametrize("group", [2, 1000])
def test_each_prompt_is_put_once(spark, tmp_path, group):
    folder, memo = tmp_path / "calls", str(tmp_path / "memo")
    folder.mkdir()
    rows = [(k, p) for k, p in enumerate(["a", "b", "a", None, "bad one", "c", "bad one"])]
    df = spark.createDataFrame(rows, "id int, `the prompt` string").repartition(3)
    run = lambda d: {r["id"]: (r["response"], r["error"]) for r in MD.call_once(d, "the prompt", counting(folder), memo, at_a_time=2, group=group).collect()}
    want = {0: ("A", None), 1: ("B", None), 2: ("A", None), 3: ("nothing", None), 4: (None, "ValueError: bad one"), 5: ("C", None), 6: (None, "ValueError: bad one")}
    assert run(df) == want and calls(folder) == [1, 1, 1, 1]
    more = df.unionByName(spark.createDataFrame([(7, "d"), (8, "b")], df.schema))
    assert run(more) == want | {4: ("BAD ONE", None), 6: ("BAD ONE", None), 7: ("D", None), 8: ("B", None)}
    assert calls(folder) == [1, 1, 1, 1, 2]  # only the failure is asked again
    assert run(df.limit(0)) == {} and run(df) == {k: v for k, v in run(more).items() if k < 7} and calls(folder) == [1, 1, 1, 1, 2]


def test_steps_ask_once(spark, tmp_path):
    folder, memo = tmp_path / "calls", str(tmp_path / "memo")
    folder.mkdir()
    logs = spark.createDataFrame([("a.md", "1", "x"), ("b.md", "2", "yy")], "file string, hash string, content string")
    for memo_ in (None, memo, memo):
        out = MD.compile_logs(logs, counting(folder), "r", "2024-01-01 00:00:00", memo=memo_)
        assert out.count() == 2 and out.where("error is not null").count() == 2  # the answer is no JSON
    assert calls(folder) == [2, 2]


def turns_of(spark, sessions):
    rows = [(s, k, "", "user", f"{s} {k}", f"**User:** {s} {k}\n") for s in sessions for k in range(3)]
    return spark.createDataFrame(rows, "session_id string, seq int, subagent string, role string, text string, rendered string")


def test_a_broken_backfill_goes_on(spark, tmp_path):
    folder, path, memo = tmp_path / "calls", str(tmp_path / "out"), str(tmp_path / "memo")
    folder.mkdir()
    names = [f"s{k:02d}" for k in range(12)]
    sessions = spark.createDataFrame([(n, datetime(2024, 1, 28 - k)) for k, n in enumerate(names)] + [("silent", datetime(2024, 1, 1))], "session_id string, mtime timestamp")
    main, answer = turns_of(spark, names), counting(folder)

    def breaks(prompt):
        if "s05" in prompt:
            raise SystemExit("the cluster is gone")
        return answer(prompt)

    run = lambda fn: resume_backfill(sessions, main, None, fn, path, group=3, memo=memo)
    with pytest.raises(Exception):
        run(breaks)
    done = {r["session_id"] for r in spark.read.parquet(f"{path}/parts").collect()}
    assert done and done <= set(names[6:])  # the oldest ones
    got = run(answer)
    once = calls(folder)
    assert len(once) == 12 and once.count(1) >= 10 and max(once) <= 2  # those of the group that broke
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got.select("session_id", "ts", "turn_count", "skip_reason", "section", "response")) == key(backfill(sessions, main, None, lambda p: p.upper()))
    assert key(run(answer)) == key(got) and calls(folder) == once
    assert resume_backfill(sessions.limit(0), main, None, answer, str(tmp_path / "none")).count() == 0


def test_turns_are_read_once_for_all_groups(spark, tmp_path):
    names, read = [f"s{k:02d}" for k in range(12)], spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    sessions = spark.createDataFrame([(n, datetime(2024, 1, 28 - k)) for k, n in enumerate(names)], "session_id string, mtime timestamp")
    main = turns_of(spark, names)
    rows, counted = main.count(), main.mapInArrow(seen, main.schema)
    reads = []
    for group in (12, 2):
        before = read.value
        assert resume_backfill(sessions, counted, None, lambda p: p.upper(), str(tmp_path / f"out{group}"), group=group).count() == 12
        reads.append(read.value - before)
    assert rows <= reads[0] == reads[1]
