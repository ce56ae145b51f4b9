"""URL filters: pattern rules found by their rarest literal token; only rules so found run their regular expression.

Only DataFrame functions are used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW_ROWS, ascii_lower, checkpoint

#: Runs of these are the literal tokens of hosts, paths and rules.
TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A regular expression with tokens that any url it fits has.

    kind "site": over host and path together, for a host, all its subdomains, and paths that begin with the rule's.
    kind "pattern": over the url with A-Z lower-cased.
    """

    verdict: str
    name: str
    pattern: str
    tokens: tuple[str, ...]
    kind: str


def site(verdict: str, name: str) -> Rule:
    """A rule like example.com/en/."""
    host, slash, path = name.partition("/")
    return Rule(verdict, name, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(re.findall(TOKEN, host)), "site")


def pattern(verdict: str, regex: str, *tokens: str) -> Rule:
    return Rule(verdict, regex, regex, tokens, "pattern")


#: The contract's rules; the longest that fits decides.
SITES = (site("allow", "com/"), site("block", "example.com/en/"), site("allow", "www.example.com/en/"), site("block", "net/es/"), site("block", "net/fr/"))

#: Words that stand for what a training corpus leaves out, where they are a whole part of a host or path.
WORDS = ("adult", "casino", "escort", "phishing", "poker", "porn", "torrent", "viagra", "warez", "xxx")

#: Decide where no site rule fits: a block by any of them, else allowed.
PATTERNS = (
    pattern("block", r"(^|[./-])spam-farm\.", "spam", "farm"),
    *(pattern("block", rf"(^|[./-]){w}([./-]|$)", w) for w in WORDS),
    pattern("block", r"/wp-login\.php($|[?#])", "wp", "login", "php"),
)

#: The token that stands for all urls, as none is empty.
EVERY = ""

#: Bytes of rules, or of urls that rules fit, that may be broadcast.
FEW_BYTES = 64 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ://."""
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.locate("://", url) > 0, F.substr(url, F.length(rest) + 4)).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substr(after, F.length(host) + 1), r"^[^?#]*", 0)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = (*SITES, *PATTERNS)) -> DataFrame:
    """A few rules as a table (verdict, name, pattern, tokens, kind); many are read from wherever they are kept."""
    rows = [F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), F.array(*map(F.lit, r.tokens)).alias("tokens"), F.lit(r.kind).alias("kind")) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _small(df: DataFrame, *texts: str) -> DataFrame:
    """df, checkpointed: broadcast if its rows and texts are known to be small."""
    row = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(f"b{k}") for k, c in enumerate(texts)]).first()
    return F.broadcast(df) if row["n"] <= FEW_ROWS // 3 and sum(row[1:]) <= FEW_BYTES else df


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Returns id_col, host, path, rule (name of the longest site rule that fits, else null), verdict.

    rules: a table as of rule_table(), by default that one. Distinct urls are split into tokens once; a rule is looked
    up by that of its tokens which the fewest rows have, and only the urls that have it run its regular expression. A
    rule without tokens has none to be looked up by: it is tried on all urls. Of site rules of one length the last by name decides. Where no site rule fits,
    a url that a blocking pattern fits is blocked, else allowed. Null urls and those without :// have an empty host and
    path; null ones are allowed. Repeated rows are judged alike; a null id is kept. Long urls are taken whole, and an
    empty table has an empty result. Other columns are ignored, whatever their names.
    """
    own = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("u"))
    host, path = host_and_path(F.col("u"))
    given = rule_table(pages.sparkSession) if rules is None else rules
    held = F.array_distinct(F.array_compact(F.coalesce("tokens", F.array().cast("array<string>"))))
    table = checkpoint(given.select(F.monotonically_increasing_id().alias("rule_id"), "verdict", "name", "pattern", held.alias("tokens"), "kind"))
    bare = F.size("tokens") == 0
    named = checkpoint(table.select("rule_id", F.explode(F.when(bare, F.array(F.lit(EVERY))).otherwise(F.col("tokens"))).alias("token")))
    tokens = F.array_distinct(F.regexp_extract_all(ascii_lower("u"), F.lit(f"({TOKEN})"), F.lit(1)))
    if not table.where(bare).isEmpty():
        tokens = F.concat(tokens, F.array(F.lit(EVERY)))
    texts = own.where("u is not null").select("u")
    every = texts.distinct().select("u", F.explode(tokens).alias("token"))
    # counted by rows, so that urls are shuffled once, for the candidates
    met = texts.select(F.explode(tokens).alias("token")).join(_small(checkpoint(named.select("token").distinct()), "token"), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    # a token that no url has cannot be met, so its rule cannot fit
    rarest = named.join(checkpoint(met), "token", "left").groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("token"))
    index = checkpoint(rarest.join(table, "rule_id").select("token", "verdict", "name", "pattern", "kind"))
    candidates = every.join(_small(index, "token", "name", "pattern"), "token")
    target = F.when(F.col("kind") == "site", F.concat(host, path)).otherwise(ascii_lower("u"))
    fits = candidates.where(F.call_function("rlike", target, F.col("pattern")))
    is_site = F.col("kind") == "site"
    best = checkpoint(fits.groupBy("u").agg(
        F.max(F.when(is_site, F.struct(F.length("name").alias("n"), "name", "verdict"))).alias("site"),
        F.max(~is_site & (F.col("verdict") == "block")).alias("blocked"),
    ))
    out = own.join(_small(best, "u", "site.name"), "u", "left")
    verdict = F.when(F.col("site").isNotNull(), F.col("site.verdict")).when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), host.alias("host"), path.alias("path"), F.col("site.name").alias("rule"), verdict.alias("verdict"))
