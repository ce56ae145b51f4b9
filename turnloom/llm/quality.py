"""Quality classifier: logistic regression over hashed word n-grams, trained follow-the-regularised-leader.

Words are runs of letters and digits or of signs. Single words, pairs, and pairs and triples of word shapes are hashed
into one weight table (a shape: kinds of characters, rough length, whether the word repeats the one before); a document is the sparse vector of its hashes' shares, and its score the logistic function of a
sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import SliceHashes, arrow_map, chunks, mix, texts_of

#: Weights are 2 ** BITS.
BITS = 18

#: Labelled documents that are learned from, at most about: a sample by a hash of id and text.
TRAIN_DOCS = 8000

EPOCHS = 4


def _classes() -> np.ndarray:
    """0 space, else bits: 1 small letter, 2 capital, 4 digit, 8 beyond ASCII, 16 sign."""
    kind = np.full(256, 16, np.uint8)
    kind[[32, *range(9, 14)]] = 0
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 4, 8
    return kind


CLASSES = _classes()


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of some texts: (row, slot, value), rows in order. Values are roots of shares; a bias has 1."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edges = np.cumsum([len(t) + 1 for t in texts])
    kind = CLASSES[data]
    group = np.where(kind == 0, 0, np.where(kind == 16, 2, 1))
    begin = np.flatnonzero(np.concatenate(([group[0] > 0], (group[1:] != group[:-1]) & (group[1:] > 0))))
    rows, slots, n_rows = np.arange(len(texts)), [np.zeros(len(texts), np.int64)], [np.arange(len(texts))]
    if len(begin):
        stop = np.flatnonzero(np.concatenate(((group[1:] != group[:-1]) & (group[:-1] > 0), [group[-1] > 0]))) + 1
        doc = np.searchsorted(edges, begin, side="right")
        word = SliceHashes(data)(begin, stop)
        shape = np.bitwise_or.reduceat(kind, begin).astype(np.uint64)
        again = np.concatenate(([False], (word[1:] == word[:-1]) & (doc[1:] == doc[:-1]))).astype(np.uint64)
        size = (np.minimum(stop - begin, 24) // 8).astype(np.uint64)
        shape = np.where(shape == 16, word, mix(shape + size * np.uint64(32) + again * np.uint64(256)))
        for salt, (h, n) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3)), 1):
            if len(h) < n:
                continue
            g = h[: len(h) - n + 1] + np.uint64(salt)
            for k in range(1, n):
                g = mix(g) + h[k : len(h) - n + 1 + k]
            inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
            slots.append((mix(g[inside]) >> np.uint64(64 - BITS)).astype(np.int64))
            n_rows.append(doc[: len(doc) - n + 1][inside])
    row, slot = np.concatenate(n_rows), np.concatenate(slots)
    code, n = np.unique(row << BITS | slot, return_counts=True)
    row, slot = code >> BITS, code & ((1 << BITS) - 1)
    total = np.bincount(row, weights=n, minlength=len(rows))
    return row, slot, np.sqrt(n / total[row])


@dataclass
class Ftrl:
    """Follow-the-regularised-leader with a step for each weight and L1 and L2 penalties."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: float, importance: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = importance * (p - label) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS) -> np.ndarray:
    """Weights, from texts in the order given; both labels count the same in sum."""
    y = np.array(labels, np.float64)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model, vectors = Ftrl(), []
    for k, end in chunks(map(len, texts)):
        row, slot, x = features(texts[k:end])
        cut = np.searchsorted(row, np.arange(end - k + 1))
        vectors += [(slot[s:e].astype(np.int32), x[s:e].astype(np.float32)) for s, e in zip(cut[:-1], cut[1:], strict=True)]
    for _ in range(epochs):
        for (at, x), label in zip(vectors, y, strict=True):
            model.learn(at, x, label, 0.5 / share if label else 0.5 / (1 - share))
    return model.weights()


def train_quality(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", docs: int = TRAIN_DOCS) -> np.ndarray:
    """Trains in one task on at most about `docs` labelled rows; returns the weights. Null labels are skipped."""
    rows = train.where(F.col(label_col).isNotNull()).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string")).alias("h"))
    n = rows.count()
    if not n:
        return np.zeros(1 << BITS)
    # rows that are the same in all of these count once, so that the task's rows are bounded
    picked = rows.where(F.pmod("h", F.lit(2**32)) < min(1.0, docs / n) * float(2**32)).distinct().withColumn("all", F.lit(0))

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("body", "ascending"), ("label", "ascending")]).combine_chunks()
        w = fit(texts_of(table["body"].combine_chunks()), table["label"].to_pylist())
        at = np.flatnonzero(w)
        return pa.table({"slot": at, "weight": w[at]})

    ship(train.sparkSession)
    out = np.zeros(1 << BITS)
    for r in picked.groupBy("all").applyInArrow(learn, "slot long, weight double").collect():  # 2 ** BITS rows at most
        out[r["slot"]] = r["weight"]
    return out


def score_quality(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Scores every whole text, from 0 to 1; higher: label 1 is likelier.

    Returns the columns of docs and score (which replaces a column of that name), whatever their names. A null text
    scores as an empty one: by the bias alone; a long one is scored whole. Without labels all scores are 0.5. Equal texts
    get equal scores, repeated rows are kept, and an empty table has an empty result. Training rows that are the same in
    id, text and label count once; they are learned from in the order of their hashes, so runs agree.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train_quality(train, id_col, text_col, label_col, train_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            texts, out = texts_of(b.column(0)), []
            for k, end in chunks(map(len, texts)):
                row, slot, x = features(texts[k:end])
                out.append(np.bincount(row, weights=w[slot] * x, minlength=end - k))
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(out), -35, 35))) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(score)], names=["extra", "score"])

    keep = [c for c in docs.columns if c != "score"]
    own = docs.select(F.col(f"`{text_col}`").cast("string").alias("body"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)]).alias("extra"))
    out = arrow_map(own, run, f"extra {own.schema['extra'].dataType.simpleString()}, score double")
    return out.select(*[F.col(f"extra.c{k}").alias(c) for k, c in enumerate(keep)], "score")
