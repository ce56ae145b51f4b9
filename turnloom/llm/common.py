"""What the text operators share: shuffle width, checkpoints, byte hashing and anchor exchange."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import FEW_ROWS as FEW_ROWS
from ..shared import broadcast_if_few as broadcast_if_few
from ..shared import checkpoint as checkpoint
from ..shared import ensure_checkpoints as ensure_checkpoints
from ..ship import ship

#: Stands for a null doc_id: it sorts before every other id.
NULL_ID = -(2**63)

#: Bytes of text that numpy handles at a time; a longer text is handled alone.
CHUNK = 1 << 18

#: Rows that a Python function gets at a time.
ROWS = 1000

#: Hashes that a map task gathers before it combines and emits them.
BLOCK = 500_000


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def key_of(column: str | Column) -> Column:
    """The id as a non-null long."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("long"), F.lit(NULL_ID))


def with_rows(own: DataFrame) -> DataFrame:
    """own: (doc, body, ...), doc as of key_of. Adds print, a fingerprint of the text, and row: what tells rows apart.

    row is the id, but where different texts stand under one id, or under none, each of them has a number that is no id.
    So what is gathered by row is of one text. Rows that are the same in id and text have one row: they fare alike.
    """
    told = own.withColumn("print", F.xxhash64("body"))
    shared = checkpoint(told.groupBy("doc").agg(F.min("print").alias("a"), F.max("print").alias("z")).where("a < z").select("doc"))
    if shared.isEmpty():
        return told.withColumn("row", F.col("doc"))
    pairs = checkpoint(told.select("doc", "print").join(broadcast_if_few(shared), "doc", "left_semi").distinct().withColumn("n", F.monotonically_increasing_id()))
    parts = pairs.groupBy(F.shiftright("n", 33).alias("part")).agg(F.count("*").alias("size"))  # a row for each partition
    before = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    numbers = pairs.join(F.broadcast(before), F.shiftright("n", 33) == F.col("part")).select("doc", "print", (F.col("n") - F.shiftleft("part", 33) + F.col("before")).alias("n"))
    numbers = checkpoint(numbers)
    count, least, most = numbers.count(), *own.where(F.col("doc") > NULL_ID).agg(F.min("doc"), F.max("doc")).first()
    base = 0 if most is None else most + 1 if most + count < 2**63 else least - count
    if base <= NULL_ID:
        raise ValueError("the ids leave no numbers for texts that share one")
    return told.join(broadcast_if_few(numbers, 2), ["doc", "print"], "left").withColumn("row", F.coalesce(F.col("n") + F.lit(base), "doc")).drop("n")


def give_back() -> None:
    """Returns freed memory to the system: Spark keeps its Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of ROWS rows at most, so that a task holds few long texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS))
        finally:
            give_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """Values of a string column as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(sizes: Iterable[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about limit bytes together."""
    begin = total = 0
    k = -1
    for k, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, k
            begin, total = k, 0
        total += n
    if k >= begin:
        yield begin, k + 1


#: Odd bases of two independent hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@lru_cache(maxsize=2)
def _byte_values(which: int) -> np.ndarray:
    return np.random.default_rng(20 + which).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** (0 .. n - 1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 2 * CHUNK), base, np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finishes a hash so that all its bits depend on all bits of the input."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class SliceHashes:
    """Polynomial prefix hashes of a byte string, from which any slice is hashed in constant time.

    which, 0 or 1, chooses between two independent hashes.
    """

    def __init__(self, data: np.ndarray, which: int = 0):
        base = _BASES[which]
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values(which)[data] * _power(np.uint64(base), len(data)), out=self.prefix[1:])
        self.back = _power(np.uint64(pow(base, -1, 2**64)), len(data) + 1)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[begin]) * self.back[begin])


class Words:
    """Words of some texts, joined by single spaces in one byte string.

    Words are runs of other bytes than space and \\x09-\\x0D. begin and end hold their places in data,
    counts the number of words of each text, first the index of its first word, index each word's number in its text.
    """

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.counts = np.array([len(w) for w in split], np.int64)
        self.text = b" ".join([b" ".join(w) for w in split if w]) + b" "
        self.data = np.frombuffer(self.text, np.uint8)
        self.end = np.flatnonzero(self.data == 32) if self.counts.sum() else np.zeros(0, np.int64)
        self.begin = np.concatenate(([0], self.end[:-1] + 1)) if len(self.end) else self.end
        self.first = np.cumsum(self.counts) - self.counts
        self.index = np.arange(len(self.end)) - np.repeat(self.first, self.counts)
        self.left = np.repeat(self.counts, self.counts) - self.index
        self.hashes = SliceHashes(self.data)

    def grams(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n words from each of the words at."""
        return self.hashes(self.begin[at], self.end[at + n - 1])


def long_batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()], names=list(columns))


# ---- anchors: which hashes occur in several places --------------------------------------------------------
#
# An anchor is (h, doc), h even. Tasks combine what they have gathered: of a hash that a task has met several times,
# only one row goes to the partition of that hash, marked by nothing; the others are known to be shared, are marked by
# the lowest bit and dealt out by document. So a partition gets a row for each hash and block of a task at most,
# however often the hash occurs.


def combine_anchors(h: np.ndarray, doc: np.ndarray, repeats_count: bool) -> pa.RecordBatch:
    """repeats_count: a hash that occurs twice in one document is shared, too."""
    h = h & ~np.uint64(1)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new_h = np.concatenate(([True], h[1:] != h[:-1]))
    new = new_h.copy()
    new[1:] |= doc[1:] != doc[:-1]
    group = np.cumsum(new_h) - 1
    rows = np.bincount(group) if repeats_count else np.bincount(group, weights=new).astype(np.int64)
    shared = rows[group] > 1
    h, doc, shared, lead = h[new], doc[new], shared[new], new_h[new]
    twice = shared & lead  # also told to the others of its own block
    marked = h | shared.astype(np.uint64)
    return long_batch(h=np.concatenate((marked, h[twice])), doc=np.concatenate((doc, doc[twice])))


def gather_anchors(blocks: Iterable[tuple[np.ndarray, np.ndarray]], repeats_count: bool) -> Iterator[pa.RecordBatch]:
    hs, docs, n = [], [], 0
    for h, doc in blocks:
        hs.append(h)
        docs.append(doc)
        n += len(h)
        if n >= BLOCK:
            yield combine_anchors(np.concatenate(hs), np.concatenate(docs), repeats_count)
            hs, docs, n = [], [], 0
    if n:
        yield combine_anchors(np.concatenate(hs), np.concatenate(docs), repeats_count)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition, the anchors whose hash came from several documents or blocks."""
    hs, docs = [], []
    for b in batches:
        h, doc = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
        known = (h & np.uint64(1)) == 1
        if known.any():
            yield long_batch(h=h[known] & ~np.uint64(1), doc=doc[known])
        hs.append(h[~known])
        docs.append(doc[~known])
    if not hs:
        return
    h, doc = np.concatenate(hs), np.concatenate(docs)
    del hs, docs
    order = np.argsort(h)
    h, doc = h[order], doc[order]
    same = h[1:] == h[:-1]
    keep = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(h) else np.zeros(0, bool)
    h, doc = h[keep], doc[keep]
    for k in range(0, len(h), 200_000):
        yield long_batch(h=h[k : k + 200_000], doc=doc[k : k + 200_000])


def shared_anchors(anchors: DataFrame) -> DataFrame:
    """anchors: (h, doc) of gather_anchors. Returns (doc, hs): for each document its hashes that occur elsewhere, too.

    Within a partition, rows of one document from different blocks count as shared; that only adds candidates.
    """
    known = F.col("h").bitwiseAND(F.lit(1)) == 1
    dealt = anchors.repartition(shuffle_width(anchors), F.when(known, F.col("doc")).otherwise(F.col("h")))
    return arrow_map(dealt, _shared, "h long, doc long").groupBy("doc").agg(F.collect_list("h").alias("hs"))


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a list column, null as empty."""
    sizes = np.diff(column.offsets.to_numpy()) * ~np.asarray(column.is_null()) if len(column) else np.zeros(0, np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), sizes.astype(np.int64)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column: str | Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(F.col(column) if isinstance(column, str) else column, UPPER, LOWER)


def copies_of(own: DataFrame) -> DataFrame:
    """own: (doc, body, print) of with_rows. Returns, checkpointed, (doc, print, copy): texts that a document with a smaller id has, too.

    print tells rows with one id and other texts apart.
    """
    sums = own.select("doc", F.unhex(F.sha2("body", 256)).alias("sum"), "print").where("sum is not null")
    first = sums.groupBy("sum").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("sum", "first")
    return checkpoint(sums.join(broadcast_if_few(checkpoint(first), 3), "sum").where("doc > first").select("doc", "print").distinct().withColumn("copy", F.lit(True)))
