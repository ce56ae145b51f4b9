"""Articles, their index, their links, and the log of what happened to them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import index_row, iso_seconds, mentions, slugify, wikilinks
from ..shared import checkpoint
from ..ship import ship
from ..sources.snapshots import commit

#: Kinds in their fixed order.
KINDS = ("concepts", "connections", "qa")

#: Characters of articles that are reviewed together, at most, where no two of them are longer.
REVIEW_CHARS = 100_000

#: Characters of a log's articles that are cut into blocks in one place, about.
SHARD_CHARS = 1 << 30

#: Blocks of a log that meet as many others in one place.
SIDE = 256

#: Cells of blocks that a task joins one after the other, about, where there are more than MANY_CELLS.
CELLS, MANY_CELLS = 8, 1000

#: Keys that a task deals out to cells, about: some 20 MB, which it sorts by cell in memory.
DEALT = 1 << 19

#: Articles or classes of a log that are compared with as many others in one place.
BLOCK = 1000

#: Fixed value.
EMPTY_INDEX = "# Knowledge Base Index\n\n| Article | Summary | Compiled From | Updated |\n|---------|---------|---------------|---------|"


def links(articles: DataFrame) -> DataFrame:
    """(src, pos, dst): a row for each link, in order, repeats kept."""
    return articles.select(F.col("key").alias("src"), F.posexplode(wikilinks("content")).alias("pos", "dst"))


def mention_pairs(articles: DataFrame) -> DataFrame:
    """Distinct (src, dst) with [[dst]] in src's content; repeats within an article go before any shuffle."""
    return articles.select(F.col("key").alias("src"), F.explode(F.array_distinct(mentions("content"))).alias("dst"))


def inbound_counts(articles: DataFrame) -> DataFrame:
    """Number of articles that mention each article; its own mention counts."""
    counts = mention_pairs(articles).groupBy("dst").agg(F.count("*").alias("n"))
    return articles.select("key").join(counts, F.col("key") == F.col("dst"), "left").select("key", F.coalesce("n", F.lit(0)).alias("inbound"))


def parse_index(text: DataFrame, column: str = "content") -> DataFrame:
    """Rows of an index table: (key, summary, sources, updated)."""
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(c))
    lines = text.select(F.explode(F.split(F.col(column), "\n")).alias("line")).where(F.col("line").rlike(r"^\| \[\["))
    got = lines.select(cells.alias("c"))
    key = F.regexp_extract(F.get("c", F.lit(1)), r"^\[\[(.*)\]\]$", 1)
    return got.select(key.alias("key"), F.get("c", F.lit(2)).alias("summary"), F.get("c", F.lit(3)).alias("sources"), F.get("c", F.lit(4)).try_cast("date").alias("updated"))


def render_index(index: DataFrame) -> DataFrame:
    return index.select("key", index_row("key", "summary", "sources", "updated").alias("line"))


def upsert_index(index: DataFrame, new: DataFrame) -> DataFrame:
    """A row for each key: of new rows first, else the one updated last."""
    every = index.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    latest = Window.partitionBy("key").orderBy(F.desc("__new"), F.desc("updated"), "summary", "sources")
    return every.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n", "__new")


#: Columns of a kept index.
INDEX_SCHEMA = "key string, summary string, sources string, updated date"


def write_index(new: DataFrame, path: str) -> int:
    """Commits new rows (upsert_index) to the index kept at path, as manifest.write_manifest does, and returns the version.
    read_snapshot with INDEX_SCHEMA reads it."""
    return commit(new.sparkSession, path, INDEX_SCHEMA, lambda index: upsert_index(index, new.select("key", "summary", "sources", "updated")))


def activity(old: DataFrame, new: DataFrame, source_col: str = "source", ts: str = "2024-01-31 00:00:00") -> DataFrame:
    """A log row (ts, op, subject, created, updated, consulted) for each compiled source: its articles that were created
    and those that were updated, sorted."""
    known = old.select("key", F.lit(True).alias("__known")).distinct()
    joined = new.select("key", F.col(source_col).alias("subject")).join(known, "key", "left")
    pick = lambda seen: F.array_join(F.array_sort(F.collect_set(F.when(F.col("__known").isNotNull() == seen, F.col("key")))), ",")
    return joined.groupBy("subject").agg(F.lit("compile").alias("op"), pick(False).alias("created"), pick(True).alias("updated")).select(F.lit(ts).cast("timestamp").alias("ts"), "op", "subject", "created", "updated", F.lit("").alias("consulted"))


def filed_activity(filed: DataFrame, ts: str = "2024-01-31 00:00:00") -> DataFrame:
    """A log row like those of activity for each answer of file_back (question, key, sources)."""
    return filed.select(F.lit(ts).cast("timestamp").alias("ts"), F.lit("query (filed)").alias("op"), F.col("question").alias("subject"), F.col("key").alias("created"), F.lit("").alias("updated"), F.array_join(F.array_sort("sources"), ",").alias("consulted"))


def activity_text(log: DataFrame) -> DataFrame:
    """(ts, subject, entry): the entries of the log as text, to be appended in order."""
    # fixed values: the lines of an entry
    linked = lambda c: F.array_join(F.transform(F.filter(F.split(c, ","), lambda k: k != ""), lambda k: F.concat(F.lit("[["), k, F.lit("]]"))), ", ")
    head = F.concat(F.lit("## ["), iso_seconds("ts"), F.lit("] "), "op", F.lit(" | "), "subject", F.lit("\n"))
    compiled = F.concat(F.lit("- Source: daily/"), "subject", F.lit("\n- Articles created: "), linked("created"), F.lit("\n"), F.when(F.col("updated") != "", F.concat(F.lit("- Articles updated: "), linked("updated"), F.lit("\n"))).otherwise(""))
    asked = F.concat(F.lit("- Question: "), "subject", F.lit("\n- Consulted: "), linked("consulted"), F.lit("\n- Filed to: "), linked("created"), F.lit("\n"))
    return log.select("ts", "subject", F.concat(head, F.when(F.col("op") == "compile", compiled).otherwise(asked)).alias("entry"))


def file_back(answers: DataFrame, updated: str = "2024-01-31") -> DataFrame:
    """Answered questions (question_id, question, consulted, answer) as articles of kind qa, one for each path: of questions
    that lead to one path the last by id, as a later answer replaces an earlier one."""
    key = F.concat(F.lit("qa/"), slugify("question"))
    text = F.concat(F.lit('---\ntitle: "Q: '), F.col("question"), F.lit('"\n---\n\n'), F.col("answer"))
    filed = answers.select("question_id", "question", F.lit("qa").alias("kind"), F.concat(key, F.lit(".md")).alias("path"), key.alias("key"), text.alias("content"), F.col("consulted").alias("sources"), F.lit(updated).cast("date").alias("updated"))
    latest = Window.partitionBy("path").orderBy(F.col("question_id").desc_nulls_last(), F.desc("content"))
    return filed.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")


def source_classes(articles: DataFrame) -> DataFrame:
    """(key, class, logs): articles that cite the same source logs are of one class, which the JSON text of its logs names."""
    each = articles.select("key", F.explode("sources").alias("source")).where("source is not null")
    logs = each.groupBy("key").agg(F.array_sort(F.collect_set("source")).alias("logs"))
    return logs.select("key", F.to_json("logs").alias("class"), "logs")


def class_pairs(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(left, right, shared): classes with a common log, left before right, and each class with itself.

    A log's classes are dealt out in blocks of about `block`, and blocks meet two at a time, so that no log is one task.
    """
    own = classes.groupBy("class").agg(F.first("logs").alias("logs"))
    each = own.select("class", F.explode("logs").alias("source"))
    blocks = each.groupBy("source").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = each.join(blocks, "source").withColumn("at", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    span = lambda a, b: F.explode(F.sequence(a, b))
    first = dealt.select("source", F.col("class").alias("x"), F.col("at").alias("p"), span(F.col("at"), F.col("blocks") - 1).alias("q"))
    second = dealt.select("source", F.col("class").alias("y"), F.col("at").alias("q"), span(F.lit(0), F.col("at")).alias("p"))
    met = first.join(second, ["source", "p", "q"]).where("p < q or x < y")
    several = met.groupBy(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right")).agg(F.count("*").alias("shared"))
    return several.unionByName(own.select(F.col("class").alias("left"), F.col("class").alias("right"), F.size("logs").cast("long").alias("shared")))


def shared_source_pairs(articles: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of articles (a < b) with a common source log, and how many logs they share.

    Logs are compared once for each two classes; then the classes' members meet in blocks of about `block`. All pairs are
    as many as the square of a log's articles: class_pairs with source_classes says the same in fewer rows.
    """
    classes = source_classes(articles)
    sizes = classes.groupBy("class").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = classes.join(sizes, "class").withColumn("at", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    members = dealt.groupBy("class", "at").agg(F.collect_list("key").alias("keys"))
    first = members.select(F.col("class").alias("left"), F.col("at").alias("p"), F.col("keys").alias("xs"))
    second = members.select(F.col("class").alias("right"), F.col("at").alias("q"), F.col("keys").alias("ys"))
    met = class_pairs(classes, block).join(first, "left").join(second, "right").where("left < right or p <= q").repartition("left", "right", "p", "q")
    pairs = met.withColumn("x", F.explode("xs")).withColumn("y", F.explode("ys")).where("left < right or p < q or x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")


def _blocks(budget: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Articles, each log and shard of them in order and in one piece: each is put into the open block while it fits. A block
        is a row, with the logs in `earlier` of all its articles; no more than it and a batch is held."""
        place, block, used, keys, common, out = None, 0, 0, [], set(), []

        def done() -> list[tuple]:
            return [(*place, block, sorted(keys), sorted(common))] if keys else []

        for rows in batches:
            for source, shard, key, size, earlier in rows[["source", "shard", "key", "size", "earlier"]].itertuples(index=False, name=None):
                if (source, shard) != place:
                    out += done()
                    place, block, used, keys = (source, shard), 0, 0, []
                elif used + size > budget:
                    out += done()
                    block, used, keys = block + 1, 0, []
                common = common.intersection(earlier) if keys else set(earlier)
                used += size
                keys.append(key)
            yield pd.DataFrame(out, columns=["source", "shard", "block", "keys", "earlier"])
            out = []
        yield pd.DataFrame(done(), columns=["source", "shard", "block", "keys", "earlier"])

    return cut


def review_blocks(articles: DataFrame, budget: int = REVIEW_CHARS, shard: int = SHARD_CHARS) -> DataFrame:
    """(source, at, n, keys, earlier), checkpointed: each log's articles in blocks, numbered from 1 to n. See review_packs.

    earlier: logs before this one that all articles of the block share.
    """
    size = F.coalesce(F.length(review_text()), F.lit(1))  # without a path there is no text
    own = articles.where("key is not null").select("key", size.cast("long").alias("size"), F.array_sort(F.array_distinct(F.array_compact("sources"))).alias("logs")).where("size(logs) > 0").dropDuplicates(["key"])
    each = checkpoint(own.select("key", "size", "logs", F.to_json("logs").alias("class"), F.explode("logs").alias("source")))
    total = each.groupBy("source").agg(F.sum("size").alias("total"))
    spread = F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long") % (1 + F.expr(f"total div {shard}"))
    dealt = each.join(total, "source").select("source", spread.alias("shard"), "class", "key", "size", F.filter("logs", lambda x: x < F.col("source")).alias("earlier"))
    ship(articles.sparkSession)
    ordered = dealt.repartition("source", "shard").sortWithinPartitions("source", "shard", "class", "key")
    made = ordered.mapInPandas(_blocks(max(1, budget // 2)), "source string, shard long, block long, keys array<string>, earlier array<string>")
    number = Window.partitionBy("source").orderBy("shard", "block")
    numbered = made.withColumn("at", F.row_number().over(number))
    return checkpoint(numbered.withColumn("n", F.count("*").over(Window.partitionBy("source")).cast("int")).select("source", "at", "n", "keys", "earlier"))


def review_cells(blocks: DataFrame, side: int = SIDE, dealt: int = DEALT) -> tuple[DataFrame, int]:
    """Blocks of review_blocks dealt out to cells (source, p, q), p <= q: cell p, q has the blocks of groups p and q of a
    log, each of `side` blocks, so that any two blocks of a log meet in one cell. Adds p, q and own, the block's group; also
    returns how many cells there are.

    A block goes to as many cells as its log has groups, so rows grow with the square of a log; a task makes rows of about
    `dealt` keys, and more blocks are more tasks.
    """
    groups = F.expr(f"(n + {side} - 1) div {side}")
    cells, keys = blocks.agg(F.sum(F.when(F.col("at") == 1, (groups * (groups + 1) / 2).cast("long"))), F.sum(groups * F.size("keys"))).first()
    own, last = F.expr(f"(at - 1) div {side}").cast("int"), F.expr(f"(n - 1) div {side}").cast("int")
    few = blocks.repartition(1 + (keys or 0) // dealt, "source", "at")
    every = few.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return every.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("other"), cells or 1


def review_packs(articles: DataFrame, budget: int = REVIEW_CHARS, shard: int = SHARD_CHARS, side: int = SIDE) -> DataFrame:
    """Packs of articles to be read together: (pack, source, keys), so that any two articles with a common source log are in
    one pack at least. articles (key, path, content, sources); a row without a key or without logs is in no pack.

    A log's articles, in the order of their logs and keys, are cut into blocks of at most half the budget in characters of
    their review_text (a longer article is a block of its own), and a pack is two blocks. So N articles of a log, b of which
    fill a block, need about (N / b)^2 / 2 packs. Where a log has one block, it is a pack if it has two articles. A pair of
    blocks whose articles all share a log that comes before is left out, as that log has packs for them.

    Long logs are cut into blocks shard by shard; blocks of all shards of a log meet, in cells of `side` by `side` blocks, so
    that a task holds a cell at a time and not a log. Rows of one key must be the same.
    """
    dealt, cells = review_cells(review_blocks(articles, budget, shard), side)
    n = max(min(cells, MANY_CELLS), cells // CELLS)
    cell = ["source", "p", "q"]
    first = dealt.where("own = p").select(*cell, "at", "n", "keys", "earlier").repartition(n, *cell)
    second = dealt.where("own = q").select(*cell, F.col("at").alias("other"), F.col("keys").alias("more"), F.col("earlier").alias("earlier2")).repartition(n, *cell)
    met = first.join(second, cell).where("(at < other or n = 1 and size(keys) > 1) and not arrays_overlap(earlier, earlier2)")
    name = F.format_string("%s#%d-%d", "source", "at", "other")
    return met.select(name.alias("pack"), "source", F.array_sort(F.array_union("keys", "more")).alias("keys"))


def review_text() -> Column:
    """An article as it is reviewed."""
    return F.concat(F.lit("## "), "path", F.lit("\n\n"), F.coalesce("content", F.lit("")))


def kb_size(articles: DataFrame) -> DataFrame:
    return articles.groupBy("kind").agg(F.count("*").alias("n"))


def whole_text(index: DataFrame, articles: DataFrame) -> DataFrame:
    """(ord, text): the index, then each article under its path, in their fixed order, for joining or packing."""
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    first = index.select(F.struct(F.lit(0).alias("kind"), F.lit("").alias("path")).alias("ord"), F.concat(F.lit("## INDEX\n\n"), "content").alias("text"))
    return first.unionByName(articles.select(F.struct(kind.alias("kind"), "path").alias("ord"), F.concat(F.lit("## "), "path", F.lit("\n\n"), "content").alias("text")))
