"""Language ID by prediction by partial matching over bytes.

For each language the contexts of up to DEPTH bytes form a tree with counts of the bytes that follow. A byte that a
context has not seen is reached by an escape to the next shorter context, where the bytes seen above no longer count.
After training the statistics are frozen, so an escape and what it excludes are one number of the context: the code
length of an unseen byte is that number and its code length in the shorter context. A text's code length in a language
is a sum over its bytes; the shortest code names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, arrow_map, broadcast_if_few, checkpoint, chunks, texts_of

#: Documents of each language that are learned from, about: a sample by a hash of id and text.
TRAIN_DOCS = 1500

#: Bytes of context.
DEPTH = 3

#: Bytes of code lengths that are broadcast at a time. Languages that need more are scored in several passes.
MODEL_BYTES = 64 << 20

UNKNOWN = "und"


def grams_of(text: bytes, start: int, end: int, depth: int) -> np.ndarray:
    """For each byte of a slice the number that its depth predecessors (zeros before the text) and itself spell."""
    data = np.frombuffer(bytes(max(0, depth - start)) + text[max(0, start - depth) : end], np.uint8).astype(np.uint64)
    n = end - start
    out = np.zeros(n, np.uint64)
    for k in range(depth + 1):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


def segments(sizes: list[int], limit: int) -> list[tuple[int, int, int]]:
    """Texts as (number, start, end), long ones in several segments."""
    return [(k, s, min(s + limit, n)) for k, n in enumerate(sizes) for s in range(0, n, limit)]


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, texts = np.array(b.column(0).to_pylist(), object), texts_of(b.column(1))
            for one in sorted(set(lang)):
                mine = [t for t, x in zip(texts, lang == one, strict=True) if x]
                parts = segments([len(t) for t in mine], 4 * CHUNK)
                for k, end in chunks((e - s for _, s, e in parts), 4 * CHUNK):
                    code, n = np.unique(np.concatenate([grams_of(mine[i], s, e, depth) for i, s, e in parts[k:end]]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return run


@dataclass
class Order:
    """Code lengths of the bytes seen after contexts of one length, and what an escape from a context costs."""

    grams: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray


@dataclass
class Trees:
    """Code lengths of some languages: a column for each. first has those without context."""

    languages: list[str]
    first: np.ndarray
    orders: list[Order]
    slot_gram: np.ndarray = field(init=False)
    slot_row: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        """A hash table over the longest grams; those that it has no room for are searched."""
        grams = self.orders[-1].grams
        self.shift = np.uint64(64 - max(10, (8 * len(grams)).bit_length()))
        self.slot_row = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.slot_gram = np.zeros(len(self.slot_row), np.uint64)
        at = self._slot(grams)
        self.slot_row[at] = np.arange(len(grams))
        self.slot_gram[at] = grams

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def bits_of(self, grams: np.ndarray) -> np.ndarray:
        """A row of code lengths for each gram."""
        at = self._slot(grams)
        row = self.slot_row[at]
        known = (row >= 0) & (self.slot_gram[at] == grams)
        out = self.orders[-1].bits[np.where(known, row, 0)] if len(self.orders[-1].bits) else np.zeros((len(grams), len(self.languages)), np.float32)
        lost = np.flatnonzero(~known)
        if len(lost):
            each, back = np.unique(grams[lost], return_inverse=True)
            out[lost] = self._searched(each)[back]
        return out

    def _searched(self, grams: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros((len(grams), len(self.languages))), np.ones(len(grams), bool)
        for k in range(len(self.orders), 0, -1):
            order = self.orders[k - 1]
            found, row = _find(order.grams, _suffix(grams, k + 1))
            out += np.where((open_ & found)[:, None], order.bits[row], 0)
            open_ &= ~found
            found, row = _find(order.contexts, _suffix(grams, k + 1) >> np.uint64(8))
            out += np.where((open_ & found)[:, None], order.escape[row], 0)
        return out + np.where(open_[:, None], self.first[(grams & np.uint64(255)).astype(np.int64)], 0)


def _suffix(grams: np.ndarray, n: int) -> np.ndarray:
    return grams & np.uint64(2 ** (8 * n) - 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def grow_trees(names: list[str], gram: np.ndarray, n: np.ndarray, depth: int = DEPTH) -> Trees | None:
    """Of each row the language, depth + 1 bytes as a number, and their count.

    A byte seen c times in a context with n bytes of k kinds has probability c / (n + k), an escape k / (n + k).
    """
    if not len(names):
        return None
    found, lang = np.unique(np.asarray(names, object).astype(str), return_inverse=True)
    gram, n, width = np.asarray(gram).astype(np.int64).view(np.uint64), np.asarray(n, np.float64), len(found)

    def summed(row: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(row * width + lang, weights=n, minlength=rows * width).reshape(rows, width)

    count = summed((gram & np.uint64(255)).astype(np.int64), 256)
    kinds, total = (count > 0).sum(0), count.sum(0)
    unseen = kinds / (total + kinds) / np.maximum(256 - kinds, 1)
    shorter = np.where(count > 0, count / (total + kinds), unseen)
    first, orders, below = -np.log2(shorter), [], np.arange(256).astype(np.uint64)
    for k in range(1, depth + 1):
        grams, row = np.unique(_suffix(gram, k + 1), return_inverse=True)
        count = summed(row, len(grams))
        contexts, context = np.unique(grams >> np.uint64(8), return_inverse=True)
        kinds, total, taken = (np.zeros((len(contexts), width)) for _ in range(3))
        under = shorter[np.searchsorted(below, _suffix(grams, k))]
        for out, x in ((kinds, count > 0), (total, count), (taken, np.where(count > 0, under, 0))):
            np.add.at(out, context, x)
        escape = np.where(kinds > 0, kinds / np.maximum(total + kinds, 1) / np.maximum(1 - taken, 1e-12), 1)
        shorter, below = np.where(count > 0, count / np.maximum(total + kinds, 1)[context], escape[context] * under), grams
        orders.append(Order(grams, -np.log2(shorter).astype(np.float32), contexts, -np.log2(escape).astype(np.float32)))
    return Trees(found.tolist(), first, orders)


def code_lengths(trees: Trees, texts: list[bytes]) -> np.ndarray:
    """Bits that each text takes in each language."""
    width = len(trees.languages)
    limit = max(1024, 4 * CHUNK // max(4, width))
    out = np.zeros((len(texts), width))
    parts = segments([len(t) for t in texts], limit)
    for k, end in chunks((e - s for _, s, e in parts), limit):
        some = parts[k:end]
        grams = np.concatenate([grams_of(texts[i], s, e, len(trees.orders)) for i, s, e in some])
        sizes = np.array([e - s for _, s, e in some])
        np.add.at(out, [i for i, _, _ in some], np.add.reduceat(trees.bits_of(grams), np.cumsum(sizes) - sizes, axis=0, dtype=np.float64))
    return out


def count_grams(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = TRAIN_DOCS, depth: int = DEPTH) -> DataFrame:
    """(lang, gram, n), checkpointed, of about `docs` documents of each language, those of the least hashes."""
    body = F.col(text_col).cast("string")
    named = train.where(F.col(lang_col).isNotNull() & body.isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), body.alias("body"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"))
    share = broadcast_if_few(checkpoint(named.groupBy("lang").agg(F.least(F.lit(1.0), docs / F.count("*")).alias("share"))))
    picked = named.join(share, "lang").where(F.pmod(F.xxhash64("id", "body"), F.lit(2**32)) < F.col("share") * float(2**32))
    return checkpoint(arrow_map(picked.select("lang", "body"), _count(depth), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def language_blocks(counts: DataFrame, most: int) -> list[list[str]]:
    """All languages by name, in blocks whose code lengths take about `most` bytes; a language may take more alone."""
    blocks, grams = [], 0
    for r in counts.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").toLocalIterator():
        if not blocks or 6 * (grams + r["n"]) * (len(blocks[-1]) + 1) > most:
            blocks.append([])
            grams = 0
        blocks[-1].append(r["lang"])
        grams += r["n"]
    return blocks


def train_trees(counts: DataFrame, languages: list[str], depth: int = DEPTH) -> Trees | None:
    """counts: of count_grams. The driver holds what the sampled documents of these languages have."""
    table = counts.where(F.col("lang").isin(languages)).toArrow()
    return grow_trees(table["lang"].to_pylist(), table["gram"].to_numpy(), table["n"].to_numpy(), depth)


def _scored(docs: DataFrame, trees: Trees, more: bool) -> DataFrame:
    """docs: (body, known, extra, lang_pred, best, total). Takes some languages into account: lang_pred has the shortest
    code so far, of best bits; total sums 2 ** (best - bits) over the languages. more: the texts are needed again."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            known = np.array(b.column(1).to_pylist(), bool)
            bits = code_lengths(t, [x if ok else b"" for x, ok in zip(texts_of(b.column(0)), known, strict=True)])
            before, total = b.column(4).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            at, best = bits.argmin(1), np.minimum(before, bits.min(1, initial=np.inf))
            names = [t.languages[k] if new else old for k, new, old in zip(at.tolist(), best < before, b.column(3).to_pylist(), strict=True)]
            with np.errstate(invalid="ignore"):
                total = np.where(np.isinf(before), 0, total * np.exp2(np.maximum(best - before, -1000))) + np.exp2(np.maximum(best[:, None] - bits, -1000)).sum(1)
            yield pa.RecordBatch.from_arrays([*([b.column(0)] if more else []), b.column(1), b.column(2), pa.array(names, pa.string()), pa.array(best), pa.array(total)], names=[*(["body"] if more else []), "known", "extra", "lang_pred", "best", "total"])

    kinds = "body string, " * more + f"known boolean, extra {docs.schema['extra'].dataType.simpleString()}, lang_pred string, best double, total double"
    return arrow_map(docs, run, kinds)


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """Predicts the language of every whole text by the shortest code.

    Returns the columns of docs, lang_pred (a language of train, or und if the text is null or has no letter, or if
    train has no language) and score (the share of 2 ** -bits of all languages; 0 for und). The text alone decides:
    equal texts get equal answers, and repeated rows are kept. Ties go to the first language by name. A long text is
    coded in segments, each with the bytes before it as context. An empty table has an empty result. Columns of docs
    named lang_pred or score are replaced. All languages of train are learned, with all their contexts; those whose
    code lengths take more than model_bytes together are broadcast one part after the other.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    counts = count_grams(train, id_col, text_col, lang_col, train_docs)
    blocks = language_blocks(counts, model_bytes)
    if not blocks:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    text = F.col(text_col).cast("string")
    out = docs.select(text.alias("body"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("known"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)]).alias("extra"), F.lit(None).cast("string").alias("lang_pred"), F.lit(float("inf")).alias("best"), F.lit(0.0).alias("total"))
    for k, languages in enumerate(blocks, 1):
        out = _scored(out, train_trees(counts, languages), k < len(blocks))
        if k < len(blocks):
            out = checkpoint(out)
    found = lambda x, y: F.when(F.col("known"), x).otherwise(F.lit(y))
    return out.select(*[F.col(f"extra.c{k}").alias(c) for k, c in enumerate(keep)], found(F.col("lang_pred"), UNKNOWN).alias("lang_pred"), found(1 / F.col("total"), 0.0).alias("score"))
