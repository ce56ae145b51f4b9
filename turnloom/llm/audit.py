"""Filter interaction audit: what each filter of a chain removes, in every order, and what it is worth.

A filter fails a document or not, so a part of the corpus is described by how many documents fail each set of filters. From
that table follows what each coalition of filters removes: the value of a cooperative game. A filter's Shapley value is
found as the exact solution of a least-squares problem: fit the coalitions' values by a sum of one number a filter, under
the Shapley kernel's weights and with the sum of all numbers fixed to what all filters remove together. Its normal equations
are solved in rationals. What a step of an order removes is the difference of two coalitions' values.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, broadcast_if_few, checkpoint, key_of, texts_of

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = b"#$%&*|"

#: Filters at most: a part's table has two to this power rows, and its result as many orders as their permutations.
MOST = 6


def kernel_equations(k: int) -> list[list[Fraction]]:
    """The inverse of the normal equations' matrix for k filters, bordered by the efficiency constraint.

    Coalitions are bit sets without the empty and the full one; a coalition of s filters weighs (k - 1) / (C(k, s) s (k - s)).
    """
    n = k + 1
    rows = [[Fraction(0)] * n + [Fraction(int(i == j)) for j in range(n)] for i in range(n)]
    for s in range(1, (1 << k) - 1):
        weight = kernel_weight(k, s)
        inside = [i for i in range(k) if s >> i & 1]
        for i in inside:
            for j in inside:
                rows[i][j] += weight
    for i in range(k):
        rows[i][k] = rows[k][i] = Fraction(1)
    for c in range(n):
        pivot = next(r for r in range(c, n) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c], strict=True)]
    return [r[n:] for r in rows]


def kernel_weight(k: int, coalition: int) -> Fraction:
    s = coalition.bit_count()
    return Fraction(k - 1, comb(k, s) * s * (k - s))


def shapley(values: list[int], inverse: list[list[Fraction]]) -> list[Fraction]:
    """Each player's Shapley value in the game that gives coalition s values[s]; values[0] is 0."""
    k = len(inverse) - 1
    if k == 1:
        return [Fraction(values[1])]
    right = [Fraction(0)] * k + [Fraction(values[-1])]
    for s in range(1, (1 << k) - 1):
        share = kernel_weight(k, s) * values[s]
        for i in range(k):
            if s >> i & 1:
                right[i] += share
    return [sum((x * y for x, y in zip(row, right, strict=True)), Fraction(0)) for row in inverse[:k]]


def coalition_values(counts: np.ndarray) -> np.ndarray:
    """counts[..., m]: documents that fail exactly the filters in m. Returns for each coalition how many it removes."""
    n = counts.shape[-1]
    sets = np.arange(n)
    return counts @ ((sets[:, None] & sets[None, :]) > 0).astype(np.int64)


def _steps(names: list[str]):
    k = len(names)
    orders = [("".join(names[i] for i in p), p) for p in permutations(range(k))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverse = kernel_equations(k)
        for b in batches:
            parts = b.column(0).to_pylist()
            for row, part in enumerate(parts):
                counts = np.zeros((3, 1 << k), np.int64)
                for m in b.column(1)[row].as_py():
                    counts[:, m["mask"]] = m["n"], m["good"], m["toxic"]
                removes = coalition_values(counts)
                total, n = int(counts[0].sum()), removes[0].tolist()
                worth = [int(x * factorial(k)) for x in shapley(n, inverse)]
                out = {c: [] for c in ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
                for order, places in orders:
                    before = 0
                    for step, i in enumerate(places, 1):
                        after = before | 1 << i
                        lost = removes[:, after] - removes[:, before]
                        values = (order, step, total - n[after], int(lost[0]), n[1 << i] - int(lost[0]), int(counts[0, 1 << i]), int(lost[1]), int(lost[2]), worth[i])
                        for c, v in zip(out, values, strict=True):
                            out[c].append(v)
                        before = after
                columns = [pa.array(v, pa.string() if c == "filter_order" else pa.int32() if c == "step" else pa.int64()) for c, v in out.items()]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(columns[0]), pa.string()), *columns], names=["part", *out])

    return run


def audit(failures: DataFrame, filters: list[str], part_col: str = "part", good_col: str = "good", toxic_col: str = "toxic") -> DataFrame:
    """Audits a chain of filters from rows (part_col, a boolean for each filter that says whether the document fails it,
    good_col, toxic_col).

    Returns a row for each part, order of the filters and step: part, filter_order (the names, joined), step, and counts of
    documents: kept after the step, removed by it, redundant (fail its filter, removed earlier), unique_fails (fail its
    filter only), good_lost and toxic_lost (removed here), shapley (removed by its filter at any step, summed over all
    orders). A null part is the empty one, a null flag is false. At most MOST filters; no rows give no parts.
    """
    k = len(filters)
    if not 1 <= k <= MOST or len(set(filters)) < k:
        raise ValueError(f"from 1 to {MOST} filters of different names")
    no = F.lit(False)
    mask = sum((F.when(F.coalesce(F.col(f"`{f}`"), no), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    number = lambda c: F.coalesce(F.col(f"`{c}`").cast("boolean"), no).cast("long")
    rows = failures.select(F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), mask.alias("mask"), number(good_col).alias("good"), number(toxic_col).alias("toxic"))
    table = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = table.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 2 ** k at most
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return arrow_map(parts, _steps(filters), schema)


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t in texts_of(b.column(0)):
            words = t.split()
            capitals = len(t) - len(t.translate(None, _CAPITALS))
            signs = len(t.translate(None, _SIGNS)) < len(t)
            chars = sum(len(x.decode("utf-8", "replace")) for x in _slices(t))
            n = len(words)
            rows.append((n < 200, 100 * len(set(words)) < 50 * n, 100 * capitals > 2 * chars, signs))
        flags = [pa.array([r[i] for r in rows], pa.bool_()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([b.column(1), *flags], names=["held", "A", "B", "C", "D"])


def _slices(text: bytes) -> Iterator[bytes]:
    """A long text in parts that cut no character."""
    begin = 0
    while begin < len(text):
        end = begin + (1 << 20)
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        yield text[begin:end]
        begin = end


def text_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Which of five filters each whole text fails: (doc, part, A, B, C, D, E), doc the id with null as the least.

    A: under 200 words (runs of other bytes than space and \\x09-\\x0D). B: fewer than half of the words differ. C: more than
    2% of the code points are A-Z. D: holds one of #$%&*|. E: the text of a document with a smaller id, or of one without an
    id, is the same. A null text is empty; an empty one fails A, and E like others. Rows that share an id do not fail E
    for each other. Texts are compared by SHA-256. Other columns are ignored, whatever their names.
    """
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    held = F.struct(key_of(F.col(f"`{id_col}`")).alias("doc"), F.col(f"`{part_col}`").cast("string").alias("part"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("sum"))
    seen = arrow_map(docs.select(body.alias("body"), held.alias("held")), _measures, "held struct<doc: long, part: string, sum: binary>, A boolean, B boolean, C boolean, D boolean")
    rows = checkpoint(seen.select("held.*", "A", "B", "C", "D"))
    least = rows.groupBy("sum").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("sum", "first")
    least = broadcast_if_few(checkpoint(least), 3)
    later: Column = F.coalesce(F.col("doc") > F.col("first"), F.lit(False))
    return rows.join(least, "sum", "left").select("doc", "part", "A", "B", "C", "D", later.alias("E"))


def audit_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """audit() of the filters of text_failures() on docs, by part; labels (id_col, quality, toxic) say what is good or toxic.

    A document is good or toxic if any row of labels with its id says so (quality = 1, toxic = 1); one without an id, or
    without a label, is neither. An empty table of labels is one without any such row.
    """
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc")).agg(one("quality").alias("good"), one("toxic").alias("toxic")).where("good or toxic")
    rows = text_failures(docs, id_col, text_col, part_col).join(broadcast_if_few(checkpoint(known)), "doc", "left")
    return audit(rows, list("ABCDE"))
