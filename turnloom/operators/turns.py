"""Transcript lines to turns, and turns to bounded session contexts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, ordered_concat, py_strip, truncate_tail
from ..ship import ship

MAX_TURNS, MAX_CHARS, TOOL_CHARS = 30, 15_000, 200

#: Least turns of a session at its end, before compaction, and in a backfill. Fixed values.
MIN_TURNS = {"session_end": 1, "pre_compact": 5, "backfill": 2}


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _is_string(v: Column) -> Column:
    """For a value that is no object or array, whose whole schema would be put together."""
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _held(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with more columns, each computed once a row: the optimizer would copy them into every filter and column that
    uses them, but not through a generator."""
    one = F.struct(*[v.alias(k) for k, v in values.items()])
    return rows.select("*", F.explode(F.array(one)).alias("__held")).select(*rows.columns, *[F.col(f"__held.{k}").alias(k) for k in values])


def _spaced_inputs(blocks: pd.Series) -> pd.Series:
    """Of each block its tool input as JSON with a space after , and :, non-ASCII kept."""

    def one(text: str | None) -> str | None:
        try:
            block = json.loads(text)
            return json.dumps(block.get("input", {}), ensure_ascii=False) if isinstance(block, dict) else None
        except (TypeError, ValueError):
            return None

    return blocks.map(lambda row: None if row is None else [one(x) for x in row])


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.when(role == "user", "**User:** ").otherwise("**Assistant:** "), py_strip(text), F.lit("\n"))


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) to turns (session_id, seq, subagent, role, text, rendered); other roles and blank texts go."""
    kept = conversations.where(F.col("role").isin("user", "assistant") & ~is_blank("text"))
    return kept.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("seq"), F.lit("").alias("subagent"), "role", py_strip("text").alias("text"), render_turn(F.col("role"), F.col("text")).alias("rendered"))


def parse_turns(lines: DataFrame, exact_tool_json: bool = False, strict: bool = False) -> DataFrame:
    """transcript_lines (session_id, subagent, line_no, raw) to turns.

    Blank and malformed lines go. The message decides role and content if it is an object; a message of another kind
    refers to the fields beside it; a line without message goes. Of content arrays, strings, text blocks and tool calls
    are joined by line ends. Tool inputs are compact JSON cut to 200 characters; exact_tool_json spaces them as JSON is
    usually dumped. strict drops whole sessions that have a line or text block of an unforeseen kind.
    """
    rows = lines.withColumn("raw", py_strip("raw")).where("raw <> ''")
    rows = _held(rows, v=F.try_parse_json("raw")).where("v is not null")
    odd = ~F.col("raw").startswith("{")
    rows = _held(rows, m=F.when(~odd, F.try_variant_get("v", "$.message", "variant")))
    fields = "role string, content string"
    rows = _held(rows, inner=_is_object(F.col("m")), top=F.from_json("raw", f"message string, {fields}"))
    rows = _held(rows, f=F.when(F.col("inner"), F.from_json("top.message", fields)).otherwise(F.struct("top.role", "top.content")), c=F.when(~odd, F.when(F.col("inner"), F.try_variant_get("m", "$.content", "variant")).otherwise(F.try_variant_get("v", "$.content", "variant"))))
    rows = _held(rows, kinds=F.try_variant_get("c", "$", "array<variant>"))
    array = F.col("kinds").isNotNull()
    rows = _held(rows, values=F.when(array, F.from_json("f.content", "array<string>")))
    if exact_tool_json:
        ship(lines.sparkSession)
        rows = rows.withColumn("inputs", F.pandas_udf(_spaced_inputs, "array<string>")("values"))
    else:
        rows = rows.withColumn("inputs", F.transform("values", lambda v: F.coalesce(F.get_json_object(v, "$.input"), F.lit("{}"))))
    rows = rows.withColumn("blocks", F.arrays_zip("values", "inputs"))
    block = "type string, text string, name string, input string"

    def part(b: Column, k: Column) -> Column:
        def of(value: Column) -> Column:
            tool = F.concat(F.lit("[Tool: "), F.coalesce(value["name"], F.lit("?")), F.lit("] "), F.left(b["inputs"], F.lit(TOOL_CHARS)))
            return F.when(value["type"] == "text", value["text"]).when(value["type"] == "tool_use", tool)

        of_object = F.transform(F.array(F.from_json(b["values"], block)), of)[0]
        return F.when(_is_object(k), of_object).when(_is_string(k), b["values"])

    parts = F.filter(F.zip_with("blocks", "kinds", part), lambda p: p.isNotNull() & ~is_blank(p))
    text = F.when(array, F.array_join(parts, "\n")).when(_is_string(F.col("c")), F.col("f.content"))
    rows = _held(rows, text=text)
    if strict:
        bad_text = F.exists(F.zip_with("values", "kinds", lambda v, k: _is_object(k) & (F.from_json(v, block)["type"] == "text") & F.from_json(v, block)["text"].isNull()), lambda x: F.coalesce(x, F.lit(False)))
        rows = rows.join(rows.where(odd | F.coalesce(F.when(array, bad_text), F.lit(False))).select("session_id").distinct(), "session_id", "left_anti")
    role = F.col("f.role")
    kept = rows.where(~odd & F.col("m").isNotNull() & role.isin("user", "assistant") & F.col("text").isNotNull() & ~is_blank("text"))
    return kept.select("session_id", F.col("line_no").cast("int").alias("seq"), "subagent", role.alias("role"), py_strip("text").alias("text"), render_turn(role, F.col("text")).alias("rendered"))


def attach_subagents(main: DataFrame, sub: DataFrame) -> DataFrame:
    """Puts each subagent's turns behind the main ones, under a header that counts as a turn; numbers all anew from 0."""
    header = sub.select("session_id", "subagent").distinct().select("session_id", F.lit(-1).alias("seq"), "subagent", F.lit("header").alias("role"), F.lit("").alias("text"), F.format_string("**[Subagent: %s]**\n", F.col("subagent")).alias("rendered"))
    every = main.withColumn("later", F.lit(0)).unionByName(sub.unionByName(header).withColumn("later", F.lit(1)))
    order = Window.partitionBy("session_id").orderBy("later", "subagent", "seq")
    return every.withColumn("seq", F.row_number().over(order) - 1).drop("later")


def last_n(turns: DataFrame, n: int = MAX_TURNS) -> DataFrame:
    """The last n turns of each session. The rank filter prunes within tasks before the shuffle."""
    order = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    return turns.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n).drop("__rank")


def build_contexts(turns: DataFrame, max_turns: int = MAX_TURNS, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row a session: context (the last turns, cut from the front at a turn), turn_count, n_chars, truncated.

    At most max_turns rows of a session are gathered, each cut to the characters that could be kept.
    """
    short = last_n(turns, max_turns).select("session_id", "seq", F.right("rendered", F.lit(max_chars + 1)).alias("part"))
    whole = short.groupBy("session_id").agg(ordered_concat(["seq"], "part", "\n").alias("whole"), F.count("*").cast("int").alias("turn_count"))
    cut = whole.select("session_id", truncate_tail("whole", max_chars).alias("context"), "turn_count", (F.length("whole") > max_chars).alias("truncated"))
    return cut.select("session_id", "context", "turn_count", F.length("context").alias("n_chars"), "truncated")


def gate(contexts: DataFrame, min_turns: int = 1) -> DataFrame:
    """Adds skip_reason: empty, too_few_turns, or null for a context that is kept."""
    return contexts.withColumn("skip_reason", F.when(is_blank("context"), "empty").when(F.col("turn_count") < min_turns, "too_few_turns"))


def turn_counts(turns: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    return turns.groupBy("session_id").agg(F.least(F.count("*"), F.lit(max_turns)).cast("int").alias("turn_count"))
