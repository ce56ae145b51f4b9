import json
import random
import re

import pytest
from pyspark.sql import functions as F

from turnloom.operators import turns as TU
from turnloom.plans import inputs as I
from turnloom.shared import LISTINGS
from turnloom.sources.files import list_sessions, latest_source, parse_hooks, read_articles, read_daily_logs, read_index, read_transcripts, write_contexts


def lines(spark, *raws, session="s"):
    return spark.createDataFrame([(session, "", k, r) for k, r in enumerate(raws)], "session_id string, subagent string, line_no int, raw string")


def texts(df):
    return [r["text"] for r in df.orderBy("seq").collect()]


def test_roles_and_message_shapes(spark):
    raws = (
        '{"role":"user","content":"no message"}', '{"message":null,"role":"user","content":"null message"}', '{"message":"s","role":"user","content":"x"}',
        '{"message":{"role":"system","content":"sys"}}', '{"message":{"role":"user","content":"  "}}', "", "   ", "{bad", "[1]", '{"message":{"role":"assistant","content":"é😀"}}', '{"message":{"role":"user","content":7}}',
    )
    assert texts(TU.parse_turns(lines(spark, *raws))) == ["null message", "x", "é😀"]


def test_blocks(spark):
    blocks = ["7", 7, {"type": "text", "text": "t"}, {"type": "text", "text": None}, {"type": "tool_use", "name": "Read", "input": {"b": 1, "a": [1, 2]}}, {"type": "tool_use"}, {"type": "tool_result", "content": "x"}, {"type": "text", "text": " "}]
    df = lines(spark, json.dumps({"message": {"role": "user", "content": blocks}}))
    assert texts(TU.parse_turns(df)) == ['7\nt\n[Tool: Read] {"b":1,"a":[1,2]}\n[Tool: ?] {}']
    assert texts(TU.parse_turns(df, exact_tool_json=True)) == ['7\nt\n[Tool: Read] {"b": 1, "a": [1, 2]}\n[Tool: ?] {}']
    assert texts(TU.parse_turns(df, strict=True)) == []


def test_tool_input_is_cut(spark):
    df = lines(spark, json.dumps({"message": {"role": "user", "content": [{"type": "tool_use", "name": "W", "input": {"x": "y" * 500}}]}}))
    assert len(texts(TU.parse_turns(df))[0]) == len("[Tool: W] ") + 200


def test_rendering_and_empty(spark):
    df = TU.parse_turns(lines(spark, '{"message":{"role":"user","content":" a "}}', '{"message":{"role":"assistant","content":"b"}}'))
    assert [r["rendered"] for r in df.orderBy("seq").collect()] == ["**User:** a\n", "**Assistant:** b\n"]
    assert TU.parse_turns(lines(spark).limit(0)).count() == 0


def turns_of(spark, session, *rendered):
    return spark.createDataFrame([(session, k, "", "user", r, r) for k, r in enumerate(rendered)], "session_id string, seq int, subagent string, role string, text string, rendered string")


def test_subagent_header_counts(spark):
    main, sub = turns_of(spark, "s", "m0", "m1"), turns_of(spark, "s", "a0").withColumn("subagent", __import__("pyspark").sql.functions.lit("agent-x"))
    out = TU.attach_subagents(main, sub)
    assert [r["rendered"] for r in out.orderBy("seq").collect()] == ["m0", "m1", "**[Subagent: agent-x]**\n", "a0"]
    row = TU.build_contexts(out, max_turns=3).first()
    assert (row["turn_count"], row["context"]) == (3, "m1\n**[Subagent: agent-x]**\n\na0")


def test_contexts_and_gate(spark):
    df = turns_of(spark, "s", "**User:** " + "x" * 30 + "\n", "**User:** yy\n").unionByName(turns_of(spark, "t", " \n"))
    out = {r["session_id"]: r for r in TU.gate(TU.build_contexts(df, max_chars=20), 2).collect()}
    assert out["s"]["context"] == "**User:** yy\n" and out["s"]["truncated"] and out["s"]["skip_reason"] is None
    assert out["t"]["skip_reason"] == "empty"
    assert TU.gate(TU.build_contexts(turns_of(spark, "u", "a")), 2).first()["skip_reason"] == "too_few_turns"


def test_hook_repair(spark):
    raws = [r'{"transcript_path": "C:\Users\new"}', r'{"session_id": "a", "source": "b", "transcript_path": "/x"}', '{"transcript_path": ""}', '{"transcript_path": 5}', "{", '{"session_id": "x"}']
    rows = parse_hooks(spark.createDataFrame([(r,) for r in raws], "raw string")).select("session_id", "source", "transcript_path").collect()
    # the lone backslashes are doubled only if the JSON does not parse as it is
    assert sorted(map(tuple, rows)) == [("a", "b", "/x"), ("unknown", "unknown", "C:\\Users\\new")]


def test_files(spark, tmp_path):
    root = tmp_path / "sessions"
    (root / "s1" / "subagents").mkdir(parents=True)
    line = lambda t: json.dumps({"message": {"role": "user", "content": t}})
    (root / "s1.jsonl").write_text(line("one") + "\r\n\n" + line("two") + "\r" + line("three"))
    (root / "s1" / "subagents" / "agent-b.jsonl").write_text(line("sub"))
    (root / "s1" / "subagents" / "agent-a.jsonl").write_text("")
    main, sub = (TU.parse_turns(read_transcripts(spark, str(root), s)) for s in (False, True))
    out = TU.attach_subagents(main, sub)
    assert [r["rendered"] for r in out.orderBy("seq").collect()] == ["**User:** one\n", "**User:** two\n", "**User:** three\n", "**[Subagent: agent-b]**\n", "**User:** sub\n"]
    assert [(r["session_id"], r["short_id"]) for r in list_sessions(spark, str(root)).collect()] == [("s1", "s1")]
    write_contexts(TU.gate(TU.build_contexts(out)), str(tmp_path / "contexts"))
    assert spark.read.parquet(str(tmp_path / "contexts")).first()["turn_count"] == 5
    dirs = spark.sql("select * from values ('a', timestamp'2024-01-01'), ('b', timestamp'2024-01-02'), ('c', null) t(dir, mtime)")
    assert latest_source(dirs).first()["dir"] == "b"


def test_knowledge_files(spark, tmp_path):
    for name, text in {"kb/concepts/a.md": "A", "kb/qa/b.md": "B", "kb/concepts/deep/c.md": "C", "kb/index.md": "I", "daily/2024-01-02.md": "log\n", "daily/x.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = read_articles(spark, str(tmp_path / "kb")).orderBy("key").collect()
    assert [(r["kind"], r["path"], r["key"], r["content"]) for r in rows] == [("concepts", "concepts/a.md", "concepts/a", "A"), ("qa", "qa/b.md", "qa/b", "B")]
    logs = read_daily_logs(spark, str(tmp_path / "daily")).collect()
    assert [(r["file"], str(r["log_date"]), r["content"], len(r["hash"])) for r in logs] == [("2024-01-02.md", "2024-01-02", "log\n", 16)]
    assert read_index(spark, str(tmp_path / "kb/index.md")).first()["content"] == "I"
    assert read_index(spark, None).first()["content"].startswith("# Knowledge Base Index")


@pytest.mark.parametrize("column", ["raw"])
def test_null_lines(spark, column):
    assert TU.parse_turns(lines(spark, None)).count() == 0


def test_lines_of_split_files(spark, tmp_path):
    """A file over many splits has the line numbers of one read whole, whatever its line ends."""
    rng = random.Random(1)
    texts = {f"f{k} +%.jsonl": "".join(rng.choice(["", "é" * rng.randrange(40), "x" * rng.randrange(300)]) + rng.choice(ends) for _ in range(400)) for k, ends in enumerate((["\n"], ["\r"], ["\r\n"], ["\n", "\r", "\r\n"]))}
    texts |= {"one.jsonl": "no end", "blank.jsonl": "\n\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = {(name.removesuffix(".jsonl"), n, line) for name, text in texts.items() for n, line in enumerate(re.split("\r\n|\r|\n", text)) if line}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = read_transcripts(spark, str(tmp_path))
            assert {(r["session_id"], r["line_no"], r["raw"]) for r in lines.collect() if r["raw"]} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_many_files_are_few_tasks(spark, tmp_path):
    """Files are written in tasks, a folder is listed once, and a listing of paths has a few tasks for each core."""
    root, group = str(tmp_path / "x y"), "many-files"
    I.named_files(spark.range(300).select(F.concat(F.lit("s +%"), "id", F.lit(".jsonl")).alias("path"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text")), root)
    I.named_files(spark.createDataFrame([("s +%7.jsonl", "anew"), ("deep/s.jsonl", "\u00e9"), ("deep/none.jsonl", None), ("qa/a.md", "q"), ("qa/deep/b.md", "q")], "path string, text string"), root)
    assert sorted(p.name for p in (tmp_path / "x y").rglob("*") if p.name.startswith(".") and not p.name.endswith(".crc")) == []
    assert (tmp_path / "x y" / "s +%7.jsonl").read_text() == "anew\n" and (tmp_path / "x y" / "deep" / "s.jsonl").read_text() == "\u00e9\n" and (tmp_path / "x y" / "deep" / "none.jsonl").read_text() == "\n"
    tracker, old = spark.sparkContext.statusTracker(), spark.conf.get(LISTINGS)
    spark.sparkContext.setJobGroup(group, group)
    try:
        sessions, lines, kb = list_sessions(spark, root), read_transcripts(spark, root), read_articles(spark, root)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert sum(s.numTasks for s in stages if s) < 300 and spark.conf.get(LISTINGS) == old
    assert {r["session_id"]: r["size"] for r in sessions.collect()} == {f"s +%{k}": 5 if k == 7 else k + 1 for k in range(300)}
    assert lines.count() == 300 and [r["key"] for r in kb.collect()] == ["qa/a"]


def test_files_are_not_listed_by_the_driver(spark, tmp_path):
    """As many articles as there may be: tasks list and read them, and find what Spark's reader does."""
    odd = {"a b+%20.md": "x".encode(), "\u00e9.md": "\u00e9\r\n".encode(), "bytes.md": b"\xff\xfe", "long.md": b"y" * (9 << 20), "empty.md": b"", "_draft.md": b"z", "_k=v.md": b"k", ".dot.md": b"z", "x.txt": b"z"}
    for kind in ("concepts", "qa"):
        (tmp_path / "k b" / kind / "deep.md").mkdir(parents=True)
        for name, text in (odd | {f"d{k}.md": b"%d" % k for k in range(200)}).items():
            (tmp_path / "k b" / kind / name).write_bytes(text)
    root = str(tmp_path / "k b")
    for where in (root, f"file://{root}", f"{root}/../k b"):
        got = read_articles(spark, where)
        assert got.inputFiles() == [] and list_sessions(spark, f"{where}/qa").inputFiles() == []
        by_spark = spark.read.text([f"{root}/concepts", f"{root}/qa"], wholetext=True, pathGlobFilter="*.md")
        want = by_spark.select(F.md5("value").alias("m")).collect()
        assert sorted(r["m"] for r in got.select(F.md5("content").alias("m")).collect()) == sorted(r["m"] for r in want) and len(want) == 2 * 205
    assert {r["path"] for r in got.where("kind = 'qa' and length(content) > 3 or path like '%+%'").collect()} == {"concepts/a b+%20.md", "qa/a b+%20.md", "qa/long.md"}
    assert read_articles(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        list_sessions(spark, str(tmp_path / "none"))
