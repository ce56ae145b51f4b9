"""The registered queries of the knowledge base's operators."""

from __future__ import annotations

import json
from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import articles as A
from ..operators import flush as FL
from ..operators import lint as L
from ..operators import manifest as M
from ..operators import model as MD
from ..operators import retrieve as R
from ..operators import turns as TU
from ..operators.backfill import backfill, resume_backfill
from ..shared import checkpoint, work_folder
from ..sources.changes import incremental_logs
from ..sources.files import latest_source as newest_folder
from ..sources.files import list_sessions, parse_hooks, read_articles, read_daily_logs, read_index, read_transcripts, write_contexts
from ..sources.snapshots import read_snapshot
from ..streaming import capture as CA
from ..streaming import stream as ST
from . import inputs as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers f; dates come out as text, so that engines' date types need not be compared."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})

    QUERIES[f.__name__] = run
    return f


# ---- turns and contexts


@_query
def turns_rendered(spark: SparkSession, d: str) -> DataFrame:
    return I.turns(spark, d).select("session_id", "seq", "role", "rendered")


@_query
def turn_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = TU.turn_counts(I.turns(spark, d))
    return counts.select("session_id", "turn_count", *[(F.col("turn_count") >= n).alias(k) for k, n in TU.MIN_TURNS.items()])


@_query
def last_n_turns(spark: SparkSession, d: str) -> DataFrame:
    return TU.last_n(I.turns(spark, d), I.TURNS).select("session_id", "seq", "rendered")


@_query
def session_contexts(spark: SparkSession, d: str) -> DataFrame:
    return TU.gate(TU.build_contexts(I.turns(spark, d), I.TURNS, I.CHARS), I.LEAST)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    c = I.table(spark, d, "conversations")
    opt = {"ignoreNullFields": "false"}
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    tool = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.lit("Read").alias("name"), F.struct(F.col("turn").alias("n")).alias("input")))
    blocks = F.concat(F.lit("["), F.to_json(text), F.lit(","), tool, F.lit(',{"type":"tool_result","content":"x"}]'))
    role = F.to_json(F.struct("role"))
    plain = F.to_json(F.struct(F.struct("role", F.col("text").alias("content")).alias("message")))
    parts = F.concat(F.lit('{"message":'), F.regexp_replace(role, r"\}$", ""), F.lit(',"content":'), blocks, F.lit("}}"))
    null = F.to_json(F.struct(F.lit(None).cast("string").alias("message"), "role", F.col("text").alias("content")), opt)
    bare = F.to_json(F.struct("role", F.col("text").alias("content")))
    shape = (F.col("conv_id") + F.col("turn")) % 4
    raw = F.when(shape == 0, plain).when(shape == 1, parts).when(shape == 2, null).otherwise(bare)
    real = c.select(F.col("conv_id").cast("string").alias("session_id"), F.lit("").alias("subagent"), F.col("turn").cast("int").alias("line_no"), raw.alias("raw"))
    junk = c.select(F.col("conv_id").cast("string").alias("session_id")).distinct().select("session_id", F.lit("").alias("subagent"), F.posexplode(F.array(F.lit("  "), F.lit('{"message":'))).alias("line_no", "raw"))
    return real.unionByName(junk.withColumn("line_no", F.col("line_no") + 1000))


@_query
def transcript_parse(spark: SparkSession, d: str) -> DataFrame:
    return TU.parse_turns(_lines(spark, d)).select("session_id", "seq", "role", "rendered")


@_query
def transcript_parse_spaced(spark: SparkSession, d: str) -> DataFrame:
    return TU.parse_turns(_lines(spark, d), exact_tool_json=True, strict=True).select("session_id", "seq", "role", "rendered")


@_query
def subagent_turns(spark: SparkSession, d: str) -> DataFrame:
    turns = I.turns(spark, d)
    conv = F.col("session_id").cast("long")
    sub = turns.where(conv % 2 == 1).withColumn("subagent", F.concat(F.lit("agent-"), "session_id")).withColumn("session_id", (conv - 1).cast("string"))
    return TU.attach_subagents(turns.where(conv % 2 == 0), sub).select("session_id", "seq", "subagent", "rendered")


# ---- flush


@_query
def flush_dedup(spark: SparkSession, d: str) -> DataFrame:
    return FL.dedup(I.flush_events(spark, d))


@_query
def flush_dedup_single_slot(spark: SparkSession, d: str) -> DataFrame:
    return FL.dedup(I.flush_events(spark, d), mode="single_slot")


@_query
def flush_route(spark: SparkSession, d: str) -> DataFrame:
    return FL.route(I.responses(spark, d))


@_query
def log_sections(spark: SparkSession, d: str) -> DataFrame:
    return FL.parse_sections(FL.route(I.responses(spark, d)))


@_query
def daily_log_render(spark: SparkSession, d: str) -> DataFrame:
    e = I.flush_events(spark, d)
    entries = FL.to_daily_entries(e.select("ts", F.col("source").alias("section"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("response")))
    return FL.render_daily(entries).select("file", "log_date", "content", T.content_hash("content").alias("hash"))


@_query
def end_of_day_trigger(spark: SparkSession, d: str) -> DataFrame:
    logs = I.daily_logs(spark, d)
    return M.end_of_day(I.flush_events(spark, d).select("ts"), logs, I.manifest(logs))


# ---- compilation


@_query
def compile_pending(spark: SparkSession, d: str) -> DataFrame:
    logs = I.daily_logs(spark, d)
    return M.pending(logs, I.manifest(logs)).select("file", "hash")


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    logs = I.daily_logs(spark, d)
    manifest = I.manifest(logs)
    day = F.dayofmonth("log_date")
    runs = M.pending(logs, manifest).select("file", "hash", F.lit("2024-02-15 00:00:00").cast("timestamp").alias("compiled_at"), F.lit("0.25").cast("decimal(18,6)").alias("cost_usd"), F.when(day % 3 == 0, "ValueError: x").alias("error"), F.concat(F.lit("run-"), (day % 2).cast("string")).alias("run_id"))
    return manifest, runs


@_query
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    return M.upsert(*_run(spark, d))


@_query
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    return M.cost_rollup(_run(spark, d)[1].where("error is null"))


@_query
def orphan_sources(spark: SparkSession, d: str) -> DataFrame:
    logs = I.daily_logs(spark, d)
    return L.orphan_sources(logs, I.manifest(logs))


@_query
def stale_sources(spark: SparkSession, d: str) -> DataFrame:
    logs = I.daily_logs(spark, d)
    return L.stale_sources(logs, I.manifest(logs))


# ---- links and lint


@_query
def wikilinks(spark: SparkSession, d: str) -> DataFrame:
    return A.links(I.articles(spark, d))


@_query
def inbound_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.inbound_counts(I.articles(spark, d))


def _known(spark: SparkSession, articles: DataFrame) -> DataFrame:
    return articles.select("key", "content").unionByName(I.extra_files(spark))


@_query
def broken_links(spark: SparkSession, d: str) -> DataFrame:
    a = I.articles(spark, d)
    return L.broken_links(a, _known(spark, a))


@_query
def orphan_pages(spark: SparkSession, d: str) -> DataFrame:
    return L.orphan_pages(I.articles(spark, d))


@_query
def missing_backlinks(spark: SparkSession, d: str) -> DataFrame:
    a = I.articles(spark, d)
    return L.missing_backlinks(a, _known(spark, a))


@_query
def sparse_articles(spark: SparkSession, d: str) -> DataFrame:
    return L.sparse(I.articles(spark, d))


@_query
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.articles(spark, d).select("key", T.body_words("content").alias("words"))


def _issues(spark: SparkSession, d: str) -> DataFrame:
    logs = I.daily_logs(spark, d)
    return L.lint(I.articles(spark, d), I.extra_files(spark), logs, I.manifest(logs))


@_query
def lint_all(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d)


@_query
def lint_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.summary(_issues(spark, d))


@_query
def lint_by_check(spark: SparkSession, d: str) -> DataFrame:
    return L.by_check(_issues(spark, d))


@_query
def lint_report(spark: SparkSession, d: str) -> DataFrame:
    return L.report_lines(checkpoint(_issues(spark, d)), "2024-01-31")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    c = I.table(spark, d, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 4
    said = F.when(k == 0, "NO_ISSUES\nCONTRADICTION: none").when(k == 1, F.concat(F.lit("CONTRADICTION: a vs b - "), F.col("conv_id").cast("string"), F.lit("\nnoise"))).when(k == 2, F.concat(F.lit("noise\n  INCONSISTENCY: "), F.col("turn").cast("string"))).otherwise("")
    return c.select(said.alias("response"))


@_query
def contradiction_parse(spark: SparkSession, d: str) -> DataFrame:
    return L.parse_contradictions(_checked(spark, d))


@_query
def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    return L.check_articles(I.articles(spark, d))


# ---- articles


@_query
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return I.table(spark, d, "documents").select("doc_id", T.slugify("text").alias("slug"))


@_query
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return I.articles(spark, d).select("key", T.content_hash("content").alias("hash"))


@_query
def article_keys(spark: SparkSession, d: str) -> DataFrame:
    a = I.articles(spark, d)
    odd = F.concat(F.split("path", "/")[0], F.lit("\\a.md."), F.split("path", "/")[1])
    rank = F.array_position(F.array(*[F.lit(k) for k in A.KINDS]), F.col("kind")).cast("int")
    return a.select("path", T.article_key("path").alias("key"), T.article_key(odd).alias("odd_key"), rank.alias("kind_rank"))


@_query
def index_rows(spark: SparkSession, d: str) -> DataFrame:
    return A.render_index(I.index_of(I.articles(spark, d)))


@_query
def index_parse(spark: SparkSession, d: str) -> DataFrame:
    return A.parse_index(A.render_index(I.index_of(I.articles(spark, d))), "line")


@_query
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    a = I.articles(spark, d)
    new = I.index_of(a.where("i % 3 = 0")).withColumn("summary", F.concat(F.lit("New "), "summary")).withColumn("updated", F.date_add("updated", 40))
    return A.upsert_index(I.index_of(a.where("i % 2 = 0")), new)


@_query
def activity_log(spark: SparkSession, d: str) -> DataFrame:
    a = I.articles(spark, d)
    return A.activity(a.where("i % 2 = 0"), a.where("i % 3 = 0").withColumn("source", F.regexp_replace(F.col("sources")[0], "^daily/", "")))


@_query
def activity_entries(spark: SparkSession, d: str) -> DataFrame:
    log = QUERIES["activity_log"](spark, d).unionByName(A.filed_activity(_filed(spark, d)))
    return A.activity_text(log).select("subject", "entry")


@_query
def source_classes(spark: SparkSession, d: str) -> DataFrame:
    return A.source_classes(I.articles(spark, d)).select("key", "class")


@_query
def shared_source_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of articles that cite the same logs; source_classes has their members."""
    return A.class_pairs(A.source_classes(I.articles(spark, d)))


@_query
def kb_size(spark: SparkSession, d: str) -> DataFrame:
    return A.kb_size(I.articles(spark, d))


@_query
def kb_text(spark: SparkSession, d: str) -> DataFrame:
    a = I.articles(spark, d)
    index = I.extra_files(spark).where("key = 'index'").select("content")
    return A.whole_text(index, a).select("ord.kind", "ord.path", F.md5("text").alias("text_md5"))


# ---- retrieval and injection


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = I.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return q, I.articles(spark, d)


@_query
def retrieve_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.top_articles(*_ranked(spark, d)).drop("question_no").fillna(0, ["score", "rank"])


@_query
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    q, a = _ranked(spark, d)
    return R.pack(R.top_articles(q, a), a).select("question_id", "n_articles", "n_chars", F.md5("pack").alias("pack_md5"))


def _filed(spark: SparkSession, d: str) -> DataFrame:
    q, a = _ranked(spark, d)
    top = R.top_articles(q, a).where("key is not null").groupBy("question_id").agg(F.array_sort(F.collect_list("key")).alias("consulted"))
    answers = q.join(top, "question_id").withColumn("answer", F.concat(F.lit("Found "), F.size("consulted").cast("string")))
    return A.file_back(answers)


@_query
def qa_file_back(spark: SparkSession, d: str) -> DataFrame:
    return _filed(spark, d).select("question_id", "key", F.array_join("sources", ",").alias("consulted"), F.md5("content").alias("content_md5"), "updated")


def _starts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    logs = I.daily_logs(spark, d)
    return logs.select(F.col("log_date").alias("d")), logs.where(~(F.dayofmonth("log_date") % 7).isin(0, 1))


@_query
def recent_log(spark: SparkSession, d: str) -> DataFrame:
    return R.recent_log(*_starts(spark, d))


def _injection(spark: SparkSession, d: str) -> DataFrame:
    dates, logs = _starts(spark, d)
    return R.build_injection(dates, I.extra_files(spark).where("key = 'index'").select("content"), logs, max_chars=2000)


@_query
def inject_context(spark: SparkSession, d: str) -> DataFrame:
    return _injection(spark, d)


@_query
def inject_payload(spark: SparkSession, d: str) -> DataFrame:
    out = R.injection_payload(_injection(spark, d))
    field = lambda k: F.get_json_object("payload", f"$.hookSpecificOutput.{k}")
    return out.select("d", field("hookEventName").alias("event"), F.md5(field("additionalContext")).alias("context_md5"))


@_query
def date_renderings(spark: SparkSession, d: str) -> DataFrame:
    e = I.flush_events(spark, d)
    return e.select("event_id", T.iso_seconds("ts").alias("iso"), T.long_date("ts").alias("long"), T.compact_stamp("ts").alias("compact"), T.after_hours("ts").alias("late"))


# ---- hooks and models


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    c = I.table(spark, d, "conversations")
    path = F.concat(F.lit("C:\\Users\\t"), F.col("conv_id").cast("string"), F.lit("\\"), F.col("turn").cast("string"))
    good = F.to_json(F.struct(F.col("conv_id").cast("string").alias("session_id"), F.col("role").alias("source"), path.alias("transcript_path")))
    lone = F.concat(F.lit('{"session_id": "'), F.col("conv_id").cast("string"), F.lit('", "transcript_path": "'), path, F.lit('"}'))
    bad = F.lit('{"session_id": ')
    raw = F.when(F.col("turn") % 3 == 0, good).when(F.col("turn") % 3 == 1, lone).otherwise(bad)
    return c.select(raw.alias("raw"))


@_query
def hook_payload_repair(spark: SparkSession, d: str) -> DataFrame:
    return parse_hooks(_payloads(spark, d)).select("session_id", "source", "transcript_path")


def _reply(prompt: str) -> str:
    if len(prompt) % 3 == 0:
        raise ValueError(f"length {len(prompt)}")
    return f"{len(prompt)}:{md5(prompt.encode()).hexdigest()}"


def _compiled(prompt: str) -> str:
    """Stands in for a compiling model: by length it fails, answers in another form, or writes an article."""
    n = len(prompt)
    if n % 4 == 0:
        raise ValueError(f"length {n}")
    article = {"path": f"concepts/n{n % 5}.md", "summary": f"Length {n}", "content": md5(prompt.encode()).hexdigest()}
    return "sorry" if n % 4 == 1 else json.dumps({"articles": [article], "cost_usd": 0.25})


def _judged(prompt: str) -> str:
    """Stands in for a model that looks for contradictions."""
    n = len(prompt)
    if n % 4 == 0:
        raise ValueError(f"length {n}")
    return {1: f"NO_ISSUES\nCONTRADICTION: {n}", 2: f"noise\n CONTRADICTION: a vs b - {n}", 3: f"INCONSISTENCY: {md5(prompt.encode()).hexdigest()}"}[n % 4]


def _called(spark: SparkSession, d: str) -> DataFrame:
    contexts = TU.build_contexts(I.turns(spark, d), I.TURNS, I.CHARS).withColumn("prompt", MD.extract_prompt())
    return MD.call_model(contexts.select("session_id", "prompt"), "prompt", _reply)


@_query
def model_extract(spark: SparkSession, d: str) -> DataFrame:
    return FL.route(MD.as_flush_response(_called(spark, d))).select("session_id", "section", "response")


@_query
def model_error_rows(spark: SparkSession, d: str) -> DataFrame:
    return MD.as_system_issue(_called(spark, d))


def _compile(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    logs = I.daily_logs(spark, d)
    manifest = I.manifest(logs)
    return manifest, MD.compile_logs(M.pending(logs, manifest), _compiled, "run-1", "2024-02-15 00:00:00")


@_query
def compile_run(spark: SparkSession, d: str) -> DataFrame:
    return _compile(spark, d)[1].select("file", "hash", "cost_usd", F.size("articles").alias("n_articles"), "error")


@_query
def compile_articles(spark: SparkSession, d: str) -> DataFrame:
    out = MD.compiled_articles(_compile(spark, d)[1])
    return out.select("kind", "path", "key", "summary", "content", F.array_join("sources", ",").alias("sources"), "updated")


@_query
def compile_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest after a run: logs whose compilation failed stay as they were."""
    return M.upsert(*_compile(spark, d))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    q, a = _ranked(spark, d)
    packed = q.join(R.pack(R.top_articles(q, a), a), "question_id")
    return MD.answer_questions(packed, _reply)


@_query
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("question_id", "answer", "error")


@_query
def query_count(spark: SparkSession, d: str) -> DataFrame:
    return MD.query_count(_answers(spark, d))


@_query
def review_packs(spark: SparkSession, d: str) -> DataFrame:
    """Which articles are reviewed together."""
    return A.review_packs(I.articles(spark, d)).select("source", F.array_join("keys", ",").alias("keys"))


@_query
def contradiction_check(spark: SparkSession, d: str) -> DataFrame:
    """All articles, any two with a common log together at least once."""
    return MD.check_contradictions(I.articles(spark, d), _judged, kept=False)


@_query
def lint_with_review(spark: SparkSession, d: str) -> DataFrame:
    """The structural checks and the model's review as one set of issues."""
    a, logs = I.articles(spark, d), checkpoint(I.daily_logs(spark, d))
    return L.lint(a, I.extra_files(spark), logs, I.manifest(logs), MD.check_contradictions(a, _judged, kept=False))


def _history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    turns = I.turns(spark, d)
    conv = F.col("session_id").cast("long")
    sub = turns.where(conv % 2 == 1).withColumn("subagent", F.concat(F.lit("agent-"), "session_id")).withColumn("session_id", (conv - 1).cast("string"))
    sessions = turns.select("session_id").distinct().withColumn("mtime", I.day("session_id").cast("timestamp"))
    return sessions, turns.where(conv % 2 == 0), sub


@_query
def backfill_sessions(spark: SparkSession, d: str) -> DataFrame:
    return backfill(*_history(spark, d), _reply)


@_query
def backfill_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Half of the history, then all of it: what is done is left out, and no prompt is put twice."""
    sessions, main, sub = _history(spark, d)
    path, memo = work_folder(spark, "backfill"), work_folder(spark, "memo")
    resume_backfill(sessions.where(F.dayofmonth("mtime") < 16), main, sub, _reply, path, memo=memo, at_a_time=4)
    return resume_backfill(sessions, main, sub, _reply, path, memo=memo, at_a_time=4)


# ---- tables and files that are written and read back


def _session_files(spark: SparkSession, d: str) -> str:
    """A folder with the transcripts of sessions, and of their subagents."""
    root, lines = work_folder(spark, "sessions"), _lines(spark, d)
    conv = F.col("session_id").cast("long")
    path = F.when(conv % 2 == 0, F.concat("session_id", F.lit(".jsonl"))).otherwise(F.concat((conv - 1).cast("string"), F.lit("/subagents/agent-"), "session_id", F.lit(".jsonl")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda r: r["raw"]), "\n")
    I.named_files(lines.groupBy("session_id").agg(text.alias("text")).select(path.alias("path"), "text"), root)
    return root


@_query
def transcript_scan(spark: SparkSession, d: str) -> DataFrame:
    """Transcript files of sessions and of their subagents, read and put together."""
    root = _session_files(spark, d)
    main, sub = (TU.parse_turns(read_transcripts(spark, root, s)) for s in (False, True))
    return TU.attach_subagents(main, sub).select("session_id", "seq", "subagent", "rendered")


@_query
def session_listing(spark: SparkSession, d: str) -> DataFrame:
    root, c = work_folder(spark, "sessions"), I.table(spark, d, "conversations")
    names = c.groupBy("conv_id").agg(F.concat(F.lit("session-"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), F.repeat(F.lit("x"), F.count("*").cast("int")).alias("text"))
    I.named_files(names, root)
    return list_sessions(spark, root).select("session_id", "short_id", "size")


@_query
def latest_source(spark: SparkSession, d: str) -> DataFrame:
    c = I.table(spark, d, "conversations")
    return newest_folder(c.select(F.concat(F.lit("dir-"), (F.col("conv_id") % 7).cast("string")).alias("dir"), I.day("conv_id").cast("timestamp").alias("mtime")))


@_query
def daily_log_scan(spark: SparkSession, d: str) -> DataFrame:
    root = work_folder(spark, "daily")
    I.named_files(I.daily_logs(spark, d).select(F.col("file").alias("path"), F.col("content").alias("text")), root)
    return read_daily_logs(spark, root).select("file", "log_date", "hash", F.length("content").alias("n_chars"))


@_query
def article_scan(spark: SparkSession, d: str) -> DataFrame:
    root = work_folder(spark, "knowledge")
    I.named_files(I.articles(spark, d).select("path", F.col("content").alias("text")), root, dealt=True)
    return read_articles(spark, root).select("kind", "path", "key", F.md5("content").alias("content_md5"))


@_query
def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    path = work_folder(spark, "manifest")
    none = M.read_manifest(spark, path)  # not there yet
    I.manifest(I.daily_logs(spark, d)).write.parquet(path)
    return M.read_manifest(spark, path).unionByName(none)


@_query
def manifest_commit(spark: SparkSession, d: str) -> DataFrame:
    """The manifest as its second version has it: records of before, then of a run. A third version comes after."""
    path, (manifest, runs) = work_folder(spark, "manifest"), _run(spark, d)
    M.write_manifest(manifest, path)
    done = M.write_manifest(runs, path)
    M.write_manifest(runs.withColumn("hash", F.lit("later")).withColumn("compiled_at", F.date_add("compiled_at", 9).cast("timestamp")), path)
    return M.read_manifest(spark, path, done)


@_query
def index_commit(spark: SparkSession, d: str) -> DataFrame:
    path, a = work_folder(spark, "index"), I.articles(spark, d)
    A.write_index(I.index_of(a.where("i % 2 = 0")), path)
    new = I.index_of(a.where("i % 3 = 0")).withColumn("summary", F.concat(F.lit("New "), "summary")).withColumn("updated", F.date_add("updated", 40))
    A.write_index(new, path)
    return read_snapshot(spark, path, A.INDEX_SCHEMA)


@_query
def index_scan(spark: SparkSession, d: str) -> DataFrame:
    path = work_folder(spark, "index")
    A.render_index(I.index_of(I.articles(spark, d))).select("line").write.text(path)
    return A.parse_index(read_index(spark, path))


@_query
def context_sink(spark: SparkSession, d: str) -> DataFrame:
    path = work_folder(spark, "contexts")
    for _ in range(2):  # a run that is repeated replaces itself
        write_contexts(QUERIES["session_contexts"](spark, d), path, "run-1")
    return spark.read.parquet(path).select("session_id", "turn_count", F.md5("context").alias("context_md5"))


# ---- streams


@_query
def stream_hooks(spark: SparkSession, d: str) -> DataFrame:
    path, out = work_folder(spark, "hooks"), work_folder(spark, "hooks-out")
    _payloads(spark, d).write.text(path)
    hooks = ST.hook_stream(spark, path).select("session_id", "source", "transcript_path")
    hooks.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_folder(spark, "hooks-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(hooks.schema).parquet(out)


@_query
def capture_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Hooks of ending sessions, some of them twice or for no file, to contexts from their transcripts; then all once more."""
    root, hooks, out = _session_files(spark, d), work_folder(spark, "hooks"), work_folder(spark, "contexts")
    conv = F.col("conv_id")
    path = F.concat(F.lit(f"{root}/"), F.when(conv % 10 == 8, "gone-").otherwise(""), conv.cast("string"), F.lit(".jsonl"))
    payload = F.to_json(F.struct(conv.cast("string").alias("session_id"), F.concat(F.lit("end-"), (conv % 3).cast("string")).alias("source"), path.alias("transcript_path")))
    turns = I.table(spark, d, "conversations").where("conv_id % 2 = 0 and turn < 2")
    turns.select(F.when(F.col("turn") == 0, payload).when(conv % 4 == 0, payload).otherwise('{"session_id": ').alias("value")).repartition(3, "conv_id").write.text(hooks)
    for _ in range(2):
        CA.capture_stream(ST.hook_stream(spark, hooks, 2), out, work_folder(spark, "capture-state")).awaitTermination()
    return spark.read.parquet(out).select("session_id", "source", "turn_count", "truncated", F.md5("context").alias("context_md5"))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.readStream.schema(I.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return raw.select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), "event_id")


@_query
def stream_flush_dedup(spark: SparkSession, d: str) -> DataFrame:
    out, state = work_folder(spark, "dedup"), work_folder(spark, "dedup-state")
    kept = ST.dedup_stream(_event_stream(spark, d))
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(out)


@_query
def stream_flush_dedup_batches(spark: SparkSession, d: str) -> DataFrame:
    """By ranges, with a state that has versions; then the same batch once more, which changes nothing."""
    out, state = work_folder(spark, "dedup"), work_folder(spark, "dedup-state")
    for _ in range(2):
        ST.dedup_batches(_event_stream(spark, d), out, state, work_folder(spark, "dedup-progress")).awaitTermination()
    return spark.read.parquet(out).select("session_id", "ts", "source", "event_id")


@_query
def stream_daily_append(spark: SparkSession, d: str) -> DataFrame:
    out = work_folder(spark, "daily")
    e = _event_stream(spark, d)
    entries = FL.to_daily_entries(e.select("ts", F.col("source").alias("section"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("response")))
    ST.append_daily(entries, out, work_folder(spark, "daily-state")).awaitTermination()
    return spark.read.parquet(out).select("log_date", "ts", "section", "content")


@_query
def incremental_run(spark: SparkSession, d: str) -> DataFrame:
    logs = checkpoint(I.daily_logs(spark, d))
    path, out = work_folder(spark, "logs"), work_folder(spark, "compiled")
    logs.write.parquet(path)

    def compile_batch(batch: DataFrame, batch_id: int) -> None:
        batch.select("file", "hash").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = spark.readStream.schema(logs.schema).parquet(path)
    ST.incremental_run(stream, lambda: I.manifest(logs), compile_batch, work_folder(spark, "compile-state")).awaitTermination()
    return spark.read.schema("file string, hash string").parquet(out).select("file", "hash")


@_query
def incremental_files(spark: SparkSession, d: str) -> DataFrame:
    """Log files in three runs: all are new, then those that were appended to come again, then nothing does."""
    root, ledger, out = work_folder(spark, "daily"), work_folder(spark, "ledger"), work_folder(spark, "pending")
    logs = checkpoint(I.daily_logs(spark, d))

    def compile_batch(batch: DataFrame, number: int) -> None:
        batch.select("file", "hash").write.mode("overwrite").parquet(f"{out}/run={number}")

    for more in (None, F.dayofmonth("log_date") % 3 == 0, F.lit(False)):
        rows = logs if more is None else logs.where(more).withColumn("content", F.concat("content", F.lit("more\n")))
        if not rows.isEmpty():
            I.named_files(rows.select(F.col("file").alias("path"), F.col("content").alias("text")), root)
        incremental_logs(spark, root, ledger, lambda: I.manifest(logs), compile_batch)
    return spark.read.schema("file string, hash string, run int").parquet(out)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return lint_all(spark, d)
