"""Column functions against literal cases and plain-Python statements of the same rules."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.functions import text as T


def one(spark, fn, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r["y"] for r in rows.select("k", fn("x").alias("y")).orderBy("k").collect()]


def test_truncate_tail_boundaries(spark):
    assert one(spark, lambda c: T.truncate_tail(c, 5), "xx\n**ab") == ["\n**ab"]
    assert one(spark, lambda c: T.truncate_tail(c, 6), "xxa\n**bc") == ["**bc"]
    assert one(spark, lambda c: T.truncate_tail(c, 5), "short", "no boundary") == ["short", "ndary"]


def test_truncate_head_exceeds_limit(spark):
    assert one(spark, lambda c: T.truncate_head(c, 3), "abcd", "abc") == ["abc\n\n...(truncated)", "abc"]


def test_links_and_mentions_differ_on_triple_brackets(spark):
    text = "[[a]] [[[b]] [[x [[c]] [[d|e]]"
    assert one(spark, T.wikilinks, text) == [["a", "[b", "x [[c", "d|e"]]
    assert one(spark, T.mentions, text) == [["a", "b", "c", "d|e"]]


def test_body_words(spark):
    assert one(spark, T.body_words, "---\nt: a---b\n---\nx y", "--- no end", "", "a\u2003b\x1cc") == [4, 3, 0, 3]


def test_slugify(spark):
    assert one(spark, T.slugify, "  Über  die_Brücke!  ", "--a--", "") == ["über-die-brücke", "a", ""]


def test_last_lines(spark):
    assert one(spark, lambda c: T.last_lines(c, 2), "a\nb\nc\n", "a\r\nb", "x") == ["b\nc", "a\nb", "x"]


def test_article_key_removes_every_md(spark):
    assert one(spark, T.article_key, "concepts\\a.md.md") == ["concepts/a"]


def test_dates(spark):
    row = spark.sql("select timestamp'2024-03-05 18:07:09' t, date'2024-03-05' d").select(T.iso_seconds("t"), T.long_date("d"), T.compact_stamp("t"), T.after_hours("t")).first()
    assert tuple(row) == ("2024-03-05T18:07:09Z", "Tuesday, March 05, 2024", "20240305-180709", True)


ALPHABET = st.text(alphabet="ab[]-_ \n\t\u00a0\u2003é*A1", max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ALPHABET, min_size=30, max_size=30))
def test_functions_against_python(spark, texts):
    def tail(x, n=12):
        if len(x) <= n:
            return x
        cut = x[-n:]
        at = cut.find("\n**")
        return cut[at + 1 :] if at > 0 else cut

    def slug(x):
        x = re.sub(r"[^\w\s-]", "", x.lower().strip())
        return re.sub(r"-+", "-", re.sub(r"[\s_]+", "-", x)).strip("-")

    def words(x):
        if x.startswith("---") and (end := x.find("---", 3)) != -1:
            x = x[end + 3 :]
        return len(x.split())

    assert one(spark, T.py_strip, *texts) == [x.strip() for x in texts]
    assert one(spark, lambda c: T.truncate_tail(c, 12), *texts) == [tail(x) for x in texts]
    assert one(spark, T.slugify, *texts) == [slug(x) for x in texts]
    assert one(spark, T.body_words, *texts) == [words(x) for x in texts]
    assert one(spark, T.wikilinks, *texts) == [re.findall(r"\[\[([^\]]+)\]\]", x) for x in texts]


def test_index_row(spark):
    df = spark.createDataFrame([("k", "s", "a", "2024-01-01")], "k string, s string, src string, u string")
    assert df.select(T.index_row("k", "s", "src", "u").alias("x")).first()["x"] == "| [[k]] | s | a | 2024-01-01 |"
    assert df.select(F.length(T.content_hash("k"))).first()[0] == 16
