"""Benchmark decontamination: a broadcast set of the benchmark's n-gram hashes meets the windows of every document.

Hits by hash are verified word by word. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import broadcast_if_small
from .common import FEW_ROWS, ascii_lower, broadcast_if_few, checkpoint, key_of, with_rows

#: What stands between words, before A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Bytes of benchmark windows that may be broadcast.
FEW_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """Words with their case. Null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def _held(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with more columns, each computed once a row: the optimizer would copy them into every column that uses them,
    but not through a generator."""
    one = F.struct(*[v.alias(k) for k, v in values.items()])
    return rows.select("*", F.explode(F.array(one)).alias("__held")).select(*rows.columns, *[F.col(f"__held.{k}").alias(k) for k in values])


def _places(words: str, n: int) -> Column:
    return F.greatest(F.size(words) - n + 1, F.lit(0))


def with_grams(rows: DataFrame, words: str, sizes: list[int]) -> DataFrame:
    """Adds g1, g2, ... for each size: hashes of all so many neighbouring words.

    Words are hashed once; a gram's hash is made of two shorter grams' hashes, so each size takes a step for each bit of
    it. lower() also folds other letters than A-Z, so windows that are equal once these are lower-cased have equal hashes.
    """
    made, columns = {1}, rows.columns
    out = _held(rows, g1=F.transform(words, lambda w: F.xxhash64(F.lower(w))))

    def add(n: int) -> None:
        nonlocal out
        if n in made:
            return
        one = 1 << ((n - 1).bit_length() - 1)
        add(one), add(n - one)
        count = _places("g1", n)
        out = _held(out, **{f"g{n}": F.zip_with(F.slice(f"g{one}", F.lit(1), count), F.slice(f"g{n - one}", F.lit(one + 1), count), lambda a, b: F.xxhash64(a, b))})
        made.add(n)

    for n in sizes:
        add(n)
    return out.select(*columns, *[f"g{n}" for n in sizes])


def benchmark_windows(benchmark: DataFrame, n: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Windows of each item: item (as text), h, size, gram (lower-cased words, a space between them), none twice.

    An item of fewer words than n, but not none, is one window.
    """
    words = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(ascii_lower(F.col(text_col).cast("string"))).alias("words")).where(F.size("words") > 0)
    parts = [words.where(F.lit(False)).select("item", F.lit(0).cast("long").alias("h"), F.lit(0).alias("size"), F.lit("").alias("gram"))]
    for size in sorted(r["size"] for r in words.select(F.least(F.size("words"), F.lit(n)).alias("size")).distinct().collect()):  # n rows at most
        mine = words.where((F.size("words") >= size) if size == n else (F.size("words") == size))
        grams = with_grams(mine, "words", [size]).select("item", "words", F.posexplode(f"g{size}").alias("at", "h"))
        parts.append(grams.select("item", "h", F.lit(size).alias("size"), F.array_join(F.slice("words", F.col("at") + 1, size), " ").alias("gram")))
    return reduce(DataFrame.unionByName, parts).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_print: bool = False) -> DataFrame:
    """Finds where windows of n benchmark words occur in documents.

    A document word inside any occurrence is hit. A document is contaminated if it has hit words and
    share * n_hit >= n_words.

    Returns id_col, n_words, n_hit, items (sorted array of item ids as strings), spans (sorted array of begin, end in
    words), contaminated; with_print also print, xxhash64 of the text, which tells rows of one id apart. Null and empty texts have no words and are never contaminated; long ones are scanned whole.
    Items without words are skipped, a null item id counts as ''. Each row is a document, whatever its id: those that share
    one, or have none, are judged by their own words. An empty benchmark contaminates nothing, and an empty table of documents has an empty
    result. Other columns are ignored, whatever their names.
    """
    listed = checkpoint(benchmark_windows(benchmark, n, item_col, item_text_col))
    windows = checkpoint(listed.select("h", "size", "gram").distinct())
    found = windows.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.octet_length("gram")).alias("bytes")).collect()  # n rows at most
    few = sum(r["n"] for r in found) <= FEW_ROWS and sum(r["bytes"] for r in found) <= FEW_BYTES
    sizes = sorted(r["size"] for r in found)
    keyed = with_rows(docs.select(F.col(f"`{id_col}`").alias("id"), key_of(F.col(f"`{id_col}`")).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("body")))
    own = _held(keyed.select("row", "body"), w=words_of(F.col("body"))).drop("body")
    whole = keyed.select("id", "print", "row", F.size(words_of(F.col("body"))).cast("long").alias("n_words"))
    if sizes:
        hashed = with_grams(own, "w", sizes)
        # the hashes of all sizes in one array; where a size's begin
        starts, before = {}, F.lit(0)
        for size in sizes:
            starts[size] = before
            before = before + _places("w", size)
        hashed = hashed.select("row", "w", F.concat(*[f"g{s}" for s in sizes]).alias("g"))
        if few:
            met = hashed.select("row", "w", F.posexplode("g").alias("place", "h")).join(F.broadcast(windows), "h")
        else:  # the texts stay behind, and join again where a hash was met
            met = hashed.select("row", F.posexplode("g").alias("place", "h")).join(windows, "h").distinct().join(own.dropDuplicates(["row"]), "row")
        start, count = F.lit(None).cast("int"), F.lit(None).cast("int")
        for size in sizes:
            start, count = F.when(F.col("size") == size, starts[size]).otherwise(start), F.when(F.col("size") == size, _places("w", size)).otherwise(count)
        at = F.col("place") - start
        # between, so that only h is a join key and words are compared at hits alone
        same = ascii_lower(F.array_join(F.slice("w", at + 1, F.col("size")), " ")).between(F.col("gram"), F.col("gram"))
        hits = met.where((at >= 0) & (at < count)).where(same).select("row", at.alias("at"), "size", "gram")
    else:
        hits = whole.where(F.lit(False)).select("row", F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit("").alias("gram"))
    hits = checkpoint(hits)
    span = F.struct(F.col("at").cast("long").alias("begin"), (F.col("at") + F.col("size")).cast("long").alias("end"))
    spans = hits.groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    items = hits.select("row", "gram").distinct().join(listed.select("gram", "item"), "gram").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["end"], s["begin"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")))["n"]
    by_row = checkpoint(spans.join(items, "row").select("row", "spans", "items", covered.alias("hit")))
    out = whole.join(broadcast_if_small(by_row), "row", "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    none = F.array().cast("array<string>")
    told = ["print"] if with_print else []
    return out.select(F.col("id").alias(id_col), *told, "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("spans", F.array().cast(out.schema["spans"].dataType)).alias("spans"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops contaminated documents, or with remove="spans" their hit words; then the words left are joined by a space.

    Returns the columns of docs, whatever their names. Edge cases as in contamination(); a text without hits stays as it
    is. Rows that are the same in id and text go together.
    """
    report = contamination(docs, benchmark, n, share, id_col, text_col, with_print=True)
    mine = report.where("contaminated" if remove == "documents" else "n_hit > 0").select(key_of(F.col(f"`{id_col}`")).alias("doc"), "print", "spans")
    hit = checkpoint(mine.groupBy("doc", "print").agg(F.first("spans").alias("spans")))
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select(key_of(F.col(f"`{id_col}`")).alias("doc"), F.xxhash64(text).alias("print"), text.alias("body"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("extra"))
    if remove == "documents":
        return own.join(broadcast_if_few(hit.drop("spans")), ["doc", "print"], "left_anti").select(*[F.col(f"extra.c{k}").alias(c) for k, c in enumerate(docs.columns)])
    left = F.filter(words_of(F.col("body")), lambda w, i: ~F.exists("spans", lambda s: (s["begin"] <= i) & (i < s["end"])))
    cleaned = F.when(F.col("spans").isNull(), F.col("body")).otherwise(F.array_join(left, " "))
    return own.join(broadcast_if_small(hit), ["doc", "print"], "left").select(*[cleaned.alias(c) if c == text_col else F.col(f"extra.c{k}").alias(c) for k, c in enumerate(docs.columns)])
