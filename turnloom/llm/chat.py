"""Chat formatting with a grammar round trip.

    chat := turn*        turn := "<|im_start|>" role "\\n" text "<|im_end|>\\n"

A conversation is rendered, parsed again by the grammar, and compared with its source; turns that come back otherwise
are escaped, until all are identical. An escape puts a backslash between "<" and "|im_" (after any that stand there),
which the parser takes away again; in roles, backslashes and line ends are escaped as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

START, END = "<|im_start|>", "<|im_end|>"

_CONTROL = re.compile(r"<(\\*)\|im_")
_ESCAPED = re.compile(r"<(\\*)\\\|im_")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n((?:(?!<\|im_start\|>|<\|im_end\|>).)*)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|im_", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|im_", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]], escaped: list[bool]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and where each turn's text lies in it."""
    parts, spans, at = [], [], 0
    for (role, text), hard in zip(turns, escaped, strict=True):
        head = START + _escape_role(role) + "\n"
        body = escape(text) if hard else text
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted chat; ValueError where the grammar does not fit."""
    at, turns = 0, []
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((_unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _comes_back(turn: tuple[str, str]) -> bool:
    try:
        return parse(render([turn], [False])[0]) == [turn]
    except ValueError:
        return False


def format_chat(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[str, str]], list[tuple[int, int]]]:
    """The formatted text, its turns as parsed from it, and the spans whose tokens a loss counts."""
    escaped = [False] * len(turns)
    while True:
        formatted, spans = render(turns, escaped)
        try:
            back = parse(formatted)
        except ValueError:
            back = []
        if back == turns:
            return formatted, back, [s for s, (role, _) in zip(spans, back, strict=True) if role == trained]
        more = [e or not _comes_back(t) for e, t in zip(escaped, turns, strict=True)]
        if more == escaped:  # whatever conflicts, all escaped turns come back
            more = [True] * len(turns)
        escaped = more


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    mask = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        out, turns, masks, loss = [], [], [], []
        for rows in b.column(1).to_pylist():
            formatted, back, spans = format_chat([(r["role"], r["text"]) for r in rows])
            out.append(formatted)
            turns.append([{"role": r, "text": t} for r, t in back])
            masks.append([{"begin": s, "end": e} for s, e in spans])
            loss.append("".join(unescape(formatted[s:e]) for s, e in spans))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(turns, kind), pa.array(masks, mask), pa.array(loss, pa.string())], names=["id", "formatted", "turns", "mask", "loss_text"])


def format_chats(chats: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formats conversations, rows by turn.

    Returns id_col, formatted, turns (role and text as read back from it), mask (begin and end of each assistant text in
    formatted, in code points), loss_text (what the mask covers, unescaped). Null roles and texts are empty. Turns
    with one number are ordered by role and text; null turns come first, null ids form one conversation; repeated rows
    are repeated turns. A conversation is one row of the result, so it is gathered in one task. Other columns are
    ignored.
    """
    row = F.struct(F.col(turn_col).alias("n"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    whole = chats.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    own = whole.select("id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("rows"))
    kind = own.schema["id"].dataType.simpleString()
    schema = f"id {kind}, formatted string, turns array<struct<role: string, text: string>>, mask array<struct<begin: long, end: long>>, loss_text string"
    return arrow_map(own, _formatted, schema).withColumnRenamed("id", id_col)
