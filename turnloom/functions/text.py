"""Column functions over text. Lengths and positions count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, beyond ASCII too. What str.strip() strips.
WS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"

#: The same class for a regular expression that keeps [ and ] to add to.
_WS_BODY = WS[1:-1]


def _c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def py_strip(column: str | Column) -> Column:
    """White space at both ends removed."""
    return F.regexp_replace(_c(column), rf"^{WS}+|{WS}+\z", "")


def is_blank(column: str | Column) -> Column:
    return py_strip(column) == ""


def slugify(column: str | Column) -> Column:
    """Lower case, only letters, digits and single hyphens, none at the ends."""
    c = F.regexp_replace(py_strip(F.lower(_c(column))), rf"[^\p{{L}}\p{{N}}_{_WS_BODY}-]", "")
    c = F.regexp_replace(F.regexp_replace(c, rf"[{_WS_BODY}_]+", "-"), "-+", "-")
    return F.regexp_replace(c, r"^-+|-+\z", "")


def content_hash(column: str | Column) -> Column:
    """First 16 hex digits of SHA-256 over the bytes."""
    return F.substring(F.sha2(_c(column).cast("binary"), 256), 1, 16)


def wikilinks(column: str | Column) -> Column:
    """All [[targets]], in order, repeats kept."""
    return F.regexp_extract_all(_c(column), F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))


def mentions(column: str | Column) -> Column:
    """Targets t for which the text contains [[t]] as a substring, t without brackets."""
    return F.regexp_extract_all(_c(column), F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))


def article_key(path: str | Column) -> Column:
    return F.replace(F.replace(_c(path), F.lit(".md"), F.lit("")), F.lit("\\"), F.lit("/"))


def body(column: str | Column) -> Column:
    """The text after its frontmatter: a leading --- through the next --- anywhere."""
    c = _c(column)
    end = F.locate("---", c, 4)
    return F.when(c.startswith("---") & (end > 0), F.substr(c, end + 3)).otherwise(c)


def word_count(column: str | Column) -> Column:
    return F.size(F.filter(F.split(_c(column), f"{WS}+"), lambda w: w != ""))


def body_words(column: str | Column) -> Column:
    return word_count(body(column))


def truncate_tail(column: str | Column, most: int) -> Column:
    """The last `most` characters; if cut, from the first line that begins with ** (but not from the cut's own start)."""
    c = _c(column)
    cut = F.right(c, F.lit(most))
    at = F.locate("\n**", cut)
    return F.when(F.length(c) <= most, c).when(at > 1, F.substr(cut, at + 1)).otherwise(cut)


def truncate_head(column: str | Column, most: int) -> Column:
    """The first `most` characters and a note, which makes the result longer than that."""
    c = _c(column)
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("\n\n...(truncated)"))).otherwise(c)


def last_lines(column: str | Column, n: int) -> Column:
    """The last n lines; a line end at the end does not begin another line."""
    lines = F.split(F.regexp_replace(_c(column), r"(\r\n|\n|\r)\z", ""), r"\r\n|\n|\r")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n)), "\n")


def ordered_concat(order: list[str], text: str, separator: str) -> Column:
    """An aggregate: texts of a group joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text"))))
    return F.array_join(F.transform(rows, lambda r: r["__text"]), separator)


def iso_seconds(ts: str | Column) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ssXXX")


def long_date(d: str | Column) -> Column:
    return F.date_format(_c(d), "EEEE, MMMM dd, yyyy")


def compact_stamp(ts: str | Column) -> Column:
    return F.date_format(_c(ts), "yyyyMMdd-HHmmss")


def after_hours(ts: str | Column, tz: str = "UTC", hour: int = 18) -> Column:
    return F.hour(F.from_utc_timestamp(_c(ts), tz)) >= hour


def index_row(key: str, summary: str, sources: str, updated: str) -> Column:
    return F.format_string("| [[%s]] | %s | %s | %s |", F.col(key), F.col(summary), F.col(sources), F.col(updated).cast("string"))
