"""Lexical retrieval of articles for many questions at once, and packing them into a context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import last_lines, long_date, ordered_concat, truncate_head
from ..shared import FEW_ROWS, broadcast_if_few, broadcast_if_small, checkpoint

#: Postings of a question's rarest terms, about, from which the bound of its scores is found.
SEED = 5000


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def terms(text: Column) -> Column:
    return F.filter(_words(text), lambda t: F.length(t) > 2)


def index_terms(articles: DataFrame, names: DataFrame) -> DataFrame:
    """Which of the terms in names (term, t) each article has: (a, key, ts), a its number, checkpointed. Rows of one key are
    one article."""
    each = articles.where("key is not null").select("key", F.explode(_words(F.col("content"))).alias("term"))  # names has none too short
    found = each.join(broadcast_if_small(names), "term").groupBy("key").agg(F.collect_set("t").alias("ts"))
    return checkpoint(found.select(F.monotonically_increasing_id().alias("a"), "key", "ts"))


def top_articles(questions: DataFrame, articles: DataFrame, k: int = 10, min_score: int = 3, seed: int = SEED) -> DataFrame:
    """questions (question_id, question), articles (key, content): the k best articles of each question.

    The score is the sum over shared terms of 1000 * (N - df) div N, a whole number, so that ties are exact and go by
    key; min_score terms must be shared. All terms count: one that all articles have weighs nothing, but is shared.

    Returns question_no, question_id, key, score, rank; a question without such an article has one row with nulls. Each row
    of questions is one by itself, numbered by question_no, whatever its id, which may be of any type, null or repeated. A
    null question or content has no terms; articles without a key are left out.

    An inverted index of the asked terms is searched with bounds: the articles found by a question's rarest terms (of about
    `seed` postings) have k-th best a score that the k best will reach. Its most common terms that weigh less together
    cannot bring an article among the best, so that only the other terms' postings are read. The 2k best of what they find
    are scored in full by the articles' own terms, which gives a bound close to the true one; of the others only those
    that the common terms can lift to it are scored so, too. No article that belongs to the best is lost.
    """
    own = checkpoint(questions.select(F.monotonically_increasing_id().alias("q"), "question_id", terms(F.col("question")).alias("terms")))
    asked = own.select("q", F.explode("terms").alias("term"))
    names = checkpoint(asked.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    index = index_terms(articles, names)
    posted = index.select("a", F.explode("ts").alias("t"))
    total = articles.where("key is not null").select("key").distinct().count()
    df = posted.groupBy("t").agg(F.count("*").alias("df"))
    weights = names.join(df, "t").select("term", "t", "df", F.expr(f"(1000L * ({total}L - df)) div {max(total, 1)}L").alias("weight"))
    weighed = checkpoint(asked.join(weights, "term").select("q", "t", "df", "weight"))
    # what is sought below is a part of this, with a row for each question at most where it is joined by question
    few = F.broadcast if weighed.count() <= FEW_ROWS else lambda part: part

    def kth(found: DataFrame) -> DataFrame:
        """(q, bound): what the k-th best of the articles found has at least; none where there are fewer."""
        best = found.where(F.col("n") >= min_score).withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"))))
        return best.where(F.col("place") <= k).groupBy("q").agg(F.min("score").alias("bound"), F.count("*").alias("places")).where(F.col("places") == k).drop("places")

    def sums(wanted: DataFrame) -> DataFrame:
        return posted.join(wanted, "t").groupBy("q", "a").agg(F.sum("weight").alias("score"), F.count("*").alias("n"))

    # a bound for each question: what the k-th best article has by the rarest terms alone
    rare = Window.partitionBy("q").orderBy("df", "t")
    first = weighed.withColumn("upto", F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(rare)).where((F.col("upto") <= seed) | (F.col("n") <= min_score))
    bounds = checkpoint(kth(sums(few(first.select("q", "t", "weight")))))

    # terms that weigh less than the bound, the lightest together, need not be looked up
    light = Window.partitionBy("q").orderBy("weight", "t").rowsBetween(Window.unboundedPreceding, 0)
    split = checkpoint(weighed.join(bounds, "q", "left").withColumn("sought", F.sum("weight").over(light) >= F.coalesce("bound", F.lit(0).cast("long"))))
    some = checkpoint(sums(few(split.where("sought").select("q", "t", "weight"))))

    # the best of what was found, scored in full, give a better bound; of the others, what the rest can lift to it
    zero = F.lit(0).cast("long")
    rest = split.where("not sought").groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("t", "weight"))).alias("rest"), F.sum("weight").alias("more"))

    def in_full(part: DataFrame) -> DataFrame:
        whole = part.join(index, "a").join(few(rest.select("q", "rest")), "q", "left").withColumn("had", F.array_intersect("ts", F.map_keys("rest")))
        score = F.col("score") + F.coalesce(F.aggregate("had", zero, lambda a, t: a + F.element_at("rest", t)), zero)
        shared = F.when(F.col("rest").isNull(), F.col("n")).otherwise(F.col("n") + F.size("had"))
        return whole.select("q", "a", "key", score.alias("score"), shared.alias("n")).where(F.col("n") >= min_score)

    lead = some.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "a"))).where(F.col("place") <= 2 * k).drop("place")
    better = checkpoint(kth(in_full(lead)).unionByName(bounds).groupBy("q").agg(F.max("bound").alias("bound")))
    near = some.join(few(better), "q", "left").join(few(rest.select("q", "more")), "q", "left").where(F.col("bound").isNull() | (F.col("score") + F.coalesce("more", zero) >= F.col("bound")))
    scored = in_full(near.select("q", "a", "score", "n"))
    top = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)
    return own.select("q", "question_id").join(top.select("q", "key", "score", "rank"), "q", "left").withColumnRenamed("q", "question_no")


def pack(ranked: DataFrame, articles: DataFrame, budget: int = 20_000) -> DataFrame:
    """Joins each question's articles in rank order while their length stays within the budget.

    ranked: of top_articles. The first article is cut to the budget if it is longer. A question without articles has an
    empty pack. Returns question_no, question_id, pack, n_articles, n_chars.
    """
    ranked = checkpoint(ranked.select("question_no", "question_id", "key", "rank"))
    found = checkpoint(ranked.where("key is not null").select("question_no", "key", "rank"))
    sized = articles.select("key", "path", "content").join(broadcast_if_few(found, 2), "key")
    text = F.concat(F.lit("## "), "path", F.lit("\n\n"), "content")
    run = Window.partitionBy("question_no").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = sized.withColumn("part", F.when(F.col("rank") == 1, truncate_head(text, budget)).otherwise(text))
    kept = kept.withColumn("used", F.sum(F.length("part")).over(run)).where((F.col("used") <= budget) | (F.col("rank") == 1))
    packed = kept.groupBy("question_no").agg(ordered_concat(["rank"], "part", "\n\n---\n\n").alias("pack"), F.count("*").alias("n_articles"), F.max("used").alias("n_chars"))
    every = ranked.where("rank is null or rank = 1").select("question_no", "question_id")
    return every.join(packed, "question_no", "left").select("question_no", "question_id", F.coalesce("pack", F.lit("")).alias("pack"), F.coalesce("n_articles", F.lit(0)).alias("n_articles"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def recent_log(dates: DataFrame, logs: DataFrame, tolerance_days: int = 1, n_lines: int = 30) -> DataFrame:
    """For each date d the log of d, or of the days before it within the tolerance; its last lines."""
    near = dates.select("d", F.explode(F.sequence(F.lit(0), F.lit(tolerance_days))).alias("back")).withColumn("log_date", F.date_sub("d", F.col("back")))
    found = near.join(logs.select("log_date", "file", "content"), "log_date").groupBy("d").agg(F.min_by(F.struct("file", "content"), "back").alias("log"))
    text = F.coalesce(last_lines("log.content", n_lines), F.lit("(no recent daily log)"))
    return dates.select("d").join(found, "d", "left").select("d", F.col("log.file").alias("file"), text.alias("recent"))


def build_injection(dates: DataFrame, index: DataFrame, logs: DataFrame, max_chars: int = 20_000, n_lines: int = 30, note: str = "(empty - no articles compiled yet)") -> DataFrame:
    """Context for a new session on each date: today, the index (one row, content), the recent log."""
    one = index.agg(F.coalesce(F.max("content"), F.lit(note)).alias("index_text"))
    rows = recent_log(dates, logs, 1, n_lines).crossJoin(F.broadcast(one))
    text = F.concat_ws("\n\n---\n\n", F.concat(F.lit("## Today\n"), long_date("d")), F.concat(F.lit("## Knowledge Base Index\n\n"), "index_text"), F.concat(F.lit("## Recent Daily Log\n\n"), "recent"))
    return rows.select("d", truncate_head(text, max_chars).alias("context"))


def injection_payload(contexts: DataFrame, event: str = "SessionStart") -> DataFrame:
    body = F.struct(F.lit(event).alias("hookEventName"), F.col("context").alias("additionalContext"))
    return contexts.select("d", F.to_json(F.struct(body.alias("hookSpecificOutput"))).alias("payload"))
