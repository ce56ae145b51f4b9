"""Mixing sources to target weights, with DataFrame functions only.

Words are summed by source, targets are levelled by weight under each source's cap, and each document is emitted
floor(rate) times plus once more with the fraction's probability, decided by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_few, checkpoint, shuffle_width

#: Words are runs of these.
WORD = r"[^\x20\x09-\x0D]+"

WEIGHTS = (3, 1, 2)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Numbers the sources by code point, null last, from 0, without sorting them all in one task."""
    n = shuffle_width(sources)
    ranged = checkpoint(sources.repartitionByRange(n, F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.join(F.broadcast(starts), "part").select("source", "source_size", (F.col("start") + inside).alias("rank"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """sizes: (source, source_size). Adds target: percent of all words dealt out by weight, at most `most` times a source.

    The level of a weight is found exactly, in integers: sources whose cap lies below the level are full, the others
    share the rest by weight, which may fill more of them. Each round is one aggregate, and a round without change ends.
    """
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = checkpoint(_ranked(sizes).select("source", "source_size", weight.alias("weight")))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    goal = percent * total  # in hundredths of words
    full_words, free = 0, None
    full = F.lit(False)
    while True:
        row = ranked.agg(F.sum(F.when(full, F.col("source_size"))).alias("f"), F.sum(F.when(~full, F.col("weight"))).alias("w"), F.count("*").alias("n")).first()
        words, weight_left = row["f"] or 0, row["w"] or 0
        if free is not None and words == full_words and weight_left == free or not weight_left:
            break
        full_words, free = words, weight_left
        # full: most * size <= weight * (goal / 100 - most * full_words) / free
        full = wide("source_size") * F.lit(100 * most * free).cast("decimal(38,0)") <= wide("weight") * F.lit(goal - 100 * most * full_words).cast("decimal(38,0)")
    if free is None:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    share = F.col("weight") * F.lit(float(goal - 100 * most * full_words)) / F.lit(float(100 * free))
    return ranked.select("source", "source_size", F.when(full, F.col("source_size") * F.lit(float(most))).otherwise(share).alias("target"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows: (key, print, ...), key a text. Adds number: 1 where a key is alone, else from 1 among the rows of the key, by
    print. Rows of a repeated key are dealt out by range, so that no key is one task; equal rows may change places."""
    repeated = checkpoint(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    if repeated.isEmpty():
        return rows.withColumn("number", F.lit(1).cast("long"))
    few = broadcast_if_few(repeated)
    alone = rows.join(few, "key", "left_anti").withColumn("number", F.lit(1).cast("long"))
    several = rows.join(few, "key", "left_semi").withColumn("tie", F.monotonically_increasing_id())
    ranged = checkpoint(several.repartitionByRange(shuffle_width(rows), "key", "print", "tie").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = checkpoint(ranged.groupBy("key", "part").agg(F.count("*").alias("n")).select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy("print", "tie"))
    counted = ranged.join(broadcast_if_few(starts), ["key", "part"]).withColumn("number", F.col("start") + inside)
    return alone.unionByName(counted.select(alone.columns))


def draw(key: str, number: str, seed: int) -> Column:
    """A number from 0 to below 1 by a hash of the seed, the id and the row's number among those of the id."""
    text = F.concat(F.lit(f"{seed}:"), key, F.when(F.col(number) > 1, F.concat(F.lit(":"), F.col(number).cast("string"))).otherwise(""))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def _taken(docs: DataFrame, extra: Column, weights: tuple[int, ...], percent: int, most: int, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(extra, size, source_size, target, copies) for each row of docs."""
    text = F.col(text_col).cast("string")
    own = docs.select(extra.alias("extra"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.xxhash64(text, F.col(source_col).cast("string")).alias("print"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"))
    targets = checkpoint(source_targets(own.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, most))
    few = broadcast_if_few(targets.select(F.col("source").alias("s"), "source_size", "target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(draw("key", "number", seed) < rate - F.floor(rate), 1).otherwise(0)
    return numbered(own).join(few, F.col("source").eqNullSafe(F.col("s"))).select("extra", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2, seed: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document.

    Returns id_col, size (words: runs of other characters than space and \\x09-\\x0D), source_size, target (of its
    source, in words), copies (floor(rate) or one more; rate = target / source_size).
    Null and empty texts have size 0; long texts are counted whole. A null source is a source of its own, sorted last.
    Rows that share an id, or have none, are numbered, and each draws for itself. A source without words has target 0
    and no copies. An empty table has an empty result. Runs with one seed agree. Other columns are ignored, whatever
    their names.
    """
    out = _taken(docs, F.col(id_col), weights, percent, most, seed, id_col, text_col, source_col)
    return out.withColumnRenamed("extra", id_col)


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2, seed: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the columns of docs and copy (from 1), a row for each copy. Edge cases as in mix(); a column of
    docs named copy is replaced."""
    keep = [c for c in docs.columns if c != "copy"]
    extra = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)])
    out = _taken(docs, extra, weights, percent, most, seed, id_col, text_col, source_col).where("copies > 0")
    return out.select(*[F.col(f"extra.c{k}").alias(c) for k, c in enumerate(keep)], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
