"""Substring dedup: difference-cover anchors, then exact windows.

Words are numbered within their document. A hash of m words is taken only at the positions in a difference cover modulo
a period v. For any two places i and j there is a shift k < v with i + k and j + k both in the cover, so two equal
windows of m + v - 1 words share an aligned anchor. Only windows with an anchor that occurs elsewhere are looked at
further: each is extended to its full length, hashed to 96 bits, and all but the first place of each are removed. Exact
copies of whole texts are settled before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, Words, arrow_map, broadcast_if_few, chunks, copies_of, flat_lists, gather_anchors, key_of, long_batch, shared_anchors, shuffle_width, texts_of, with_rows

#: Difference covers: period -> positions. All differences modulo the period occur between two of the positions.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of 8 words, or else of as many as there are."""
    v = max((v for v in COVERS if window - v + 1 >= min(8, window - 2)), default=3)
    return (v, COVERS[v]) if window >= 4 else (1, (0,))


def _anchor_words(words: Words, window: int) -> tuple[np.ndarray, int]:
    v, cover = cover_for(window)
    m = window - v + 1
    return np.flatnonzero(np.isin(words.index % v, cover) & (words.left >= m)), m


def _anchors(window: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(), texts_of(b.column(1))
            for k, end in chunks(map(len, texts)):
                words = Words(texts[k:end])
                at, m = _anchor_words(words, window)
                at = at[(words.counts >= window).repeat(words.counts)[at]]
                if len(at):
                    yield words.grams(at, m), np.repeat(ids[k:end], words.counts)[at]

    return lambda batches: gather_anchors(blocks(batches), repeats_count=True)


def _candidates(words: Words, hs: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """Whether each word begins a window that has an anchor among its document's shared hashes."""
    at, m = _anchor_words(words, window)
    found = np.zeros(len(words.begin) + 1, np.int64)
    if len(at) and len(hs):
        # a hash counts only in its own document: both sides are mixed with the document's number
        doc = np.repeat(np.arange(len(sizes)), words.counts)[at].astype(np.uint64)
        mine = hs.view(np.uint64) + np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        found[at[np.isin((words.grams(at, m) & ~np.uint64(1)) + doc * np.uint64(0x9E3779B97F4A7C15), mine)]] = 1
    before = np.concatenate(([0], np.cumsum(found)))
    fits = words.left >= window
    begin = np.arange(len(words.begin))
    return fits & (before[np.minimum(begin + window - m + 1, len(found))] > before[begin])


def _first_places(a: np.ndarray, b: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of equal windows (a, b), the first in each row of the least id: only these may be the first of all."""
    order = np.lexsort((at, row, doc, b, a))
    a, b, doc, row, at = a[order], b[order], doc[order], row[order], at[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    least = doc[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
    keep = (doc == least) & (new | np.concatenate(([True], row[1:] != row[:-1])))
    return a[keep], b[keep], doc[keep], row[keep], at[keep]


def _windows(window: int):
    def combined(parts: list[tuple]) -> pa.RecordBatch:
        a, b, doc, row, at = _first_places(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return long_batch(w=a, rest=(b << np.uint64(32)) | at.astype(np.uint64), doc=doc, row=row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            rows, texts, docs = batch.column(0).to_numpy(), texts_of(batch.column(1)), batch.column(5).to_numpy()
            hs, sizes = flat_lists(batch.column(2))
            ends = np.cumsum(sizes)
            for k, end in chunks(map(len, texts)):
                words = Words(texts[k:end])
                at = np.flatnonzero(_candidates(words, hs[ends[k] - sizes[k] : ends[end - 1]], sizes[k:end], window))
                if not len(at):
                    continue
                text = words.text
                raw = b"".join([xxhash.xxh3_128_digest(text[i:j]) for i, j in zip(words.begin[at].tolist(), words.end[at + window - 1].tolist(), strict=True)])
                both = np.frombuffer(raw, "<u8").reshape(-1, 2)
                parts.append((both[:, 0], both[:, 1] >> np.uint64(32), np.repeat(docs[k:end], words.counts)[at], np.repeat(rows[k:end], words.counts)[at], words.index[at]))
                n += len(at)
                if n >= BLOCK:
                    yield combined(parts)
                    parts, n = [], 0
        if parts:
            yield combined(parts)

    return run


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition of windows: (row, start) of the first places of each."""
    table = [tuple(c.to_numpy() for c in b.columns) for b in batches]
    if not table:
        return
    w, rest, doc, row = (np.concatenate(x) for x in zip(*table, strict=True))
    del table
    rest = rest.view(np.uint64)
    *_, row, at = _first_places(w, rest >> np.uint64(32), doc, row, (rest & np.uint64(0xFFFFFFFF)).astype(np.int64))
    for k in range(0, len(row), 200_000):
        yield long_batch(row=row[k : k + 200_000], start=at[k : k + 200_000])


def _removal(window: int, as_is: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(0))
            (hs, sizes), (firsts, first_sizes) = flat_lists(batch.column(1)), flat_lists(batch.column(2))
            ends, first_ends = np.cumsum(sizes), np.cumsum(first_sizes)
            copy = np.array(batch.column(3).to_pylist(), bool)
            kept, n_words, n_removed = [], [], []
            for k, end in chunks(map(len, texts)):
                words = Words(texts[k:end])
                repeated = _candidates(words, hs[ends[k] - sizes[k] : ends[end - 1]], sizes[k:end], window)
                mine = firsts[first_ends[k] - first_sizes[k] : first_ends[end - 1]]
                repeated[np.repeat(words.first, first_sizes[k:end]) + mine] = False
                repeated |= np.repeat(copy[k:end], words.counts) & (words.left >= window)
                edge = np.zeros(len(words.begin) + window + 1, np.int64)
                at = np.flatnonzero(repeated)
                edge[at] += 1
                np.subtract.at(edge, at + window, 1)
                gone = np.cumsum(edge)[: len(words.begin)] > 0
                lost = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first) * (words.counts > 0)
                for j, (n, m, first) in enumerate(zip(words.counts.tolist(), lost.tolist(), words.first.tolist(), strict=True)):
                    if m == 0 and as_is:
                        kept.append(texts[k + j])
                    elif m == 0:
                        kept.append(words.text[words.begin[first] : words.end[first + n - 1]] if n else b"")
                    else:
                        alive = np.flatnonzero(~gone[first : first + n]) + first
                        kept.append(b" ".join([words.text[s:e] for s, e in zip(words.begin[alive].tolist(), words.end[alive].tolist(), strict=True)]))
                    n_words.append(n)
                    n_removed.append(m)
            yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["extra", "kept", "n_words", "n_removed"])

    return run


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """Removes each word covered by `window` words whose sequence also starts earlier.

    Words are runs of other characters than space and \\x09-\\x0D, compared as they are. Earlier: in a document with a
    smaller id, or in the same document at a smaller start. Windows are judged on the input. Rows that share an id, or have
    none, are documents by themselves of which none is earlier than another; a null id is smaller than all others.

    Returns id_col, the columns named in carry, kept (the words left, joined by one space; with as_is, a text
    that loses nothing is kept as it is), n_words, n_removed.
    A null or empty text has no words. A document of fewer words than the window loses nothing. Other columns are ignored,
    whatever their names.
    """
    extra = F.struct(F.col(f"`{id_col}`").alias("i"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)])
    full = with_rows(docs.select(key_of(F.col(f"`{id_col}`")).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("body"), extra.alias("extra")))
    copies = broadcast_if_few(copies_of(full))
    firsts_only = full.join(copies, ["doc", "print"], "left_anti").select("row", "body")
    hs = shared_anchors(arrow_map(firsts_only, _anchors(window), "h long, doc long")).withColumnRenamed("doc", "row")
    # both uses of the texts have the same columns and filters, so that Spark shuffles them once; copies have no hs
    joined = full.join(copies, ["doc", "print"], "left").join(hs, "row", "left").select("row", "body", "hs", "extra", F.col("copy").isNotNull().alias("copy"), "doc")
    windows = arrow_map(joined.where("hs is not null"), _windows(window), "w long, rest long, doc long, row long")
    firsts = arrow_map(windows.repartition(shuffle_width(docs), "w"), _firsts, "row long, start long")
    starts = firsts.groupBy("row").agg(F.collect_list("start").alias("firsts"))
    last = joined.join(starts, "row", "left").select("body", "hs", "firsts", "copy", "extra", "doc")
    kinds = last.schema["extra"].dataType.simpleString()
    out = arrow_map(last, _removal(window, as_is), f"extra {kinds}, kept string, n_words long, n_removed long")
    return out.select(F.col("extra.i").alias(id_col), *[F.col(f"extra.c{k}").alias(c) for k, c in enumerate(carry)], "kept", "n_words", "n_removed")
