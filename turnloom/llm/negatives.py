"""Hard-negative mining: exact inner products by the method of the Four Russians.

A row's components are cut into groups of eight and written as bit planes: byte g of plane b holds bit b of the eight
components of group g. An anchor has a table for each group with the sums of all 256 subsets of its eight components. A
score is then a sum of lookups, the planes' bytes being the indices: from the highest plane (which counts negatively, two's
complement) to the lowest, the score is doubled and the plane's lookups are added. Everything is in integers, so that scores
are exact, and a whole block of anchors is looked up with one index.

Anchors meet all rows in blocks of both; each block keeps the best few of each anchor, and these are merged. So a task holds
two blocks, whatever the number of rows, and no anchor or row is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .common import checkpoint, shuffle_width

#: Anchors and rows that meet in a task at most, about.
ANCHORS, ROWS = 1024, 65536

#: Rows that a block has at least where there are enough, as it costs a result for each anchor.
FEW_ROWS = 1024

#: Anchors whose tables are made at a time.
AT_A_TIME = 64


def subset_sums(vectors: np.ndarray) -> np.ndarray:
    """vectors (n, 8 g): integers. Returns (g, 256, n): for each group and byte the sum of the components whose bits are set."""
    n, d = vectors.shape
    groups = vectors.reshape(n, d // 8, 8).transpose(1, 2, 0)
    out = np.zeros((d // 8, 256, n), np.int64)
    for bit in range(8):  # the sums with this bit set are those without it and one component more
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + groups[:, bit, None]
    return out


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """vectors (n, 8 g): integers. Returns (planes, g, n) bytes in two's complement, the lowest plane first."""
    least, most = (int(vectors.min()), int(vectors.max())) if vectors.size else (0, 0)
    width = 1 + max(most.bit_length(), (-least - 1).bit_length() if least < 0 else 0)
    weights = np.left_shift(1, np.arange(8, dtype=np.int64))
    n, d = vectors.shape
    return np.stack([(((vectors >> b) & 1).reshape(n, d // 8, 8) @ weights).astype(np.uint8).T for b in range(width)])


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products (rows, anchors) from the anchors' subset sums and the rows' bit planes."""
    top = int(np.abs(tables).max(axis=1).sum(axis=0).max()) if tables.size else 0
    tables = tables.astype(np.int32 if top << planes.shape[0] < 2**31 else np.int64)
    out = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    for b in range(planes.shape[0] - 1, -1, -1):
        out += out
        for table, index in zip(tables, planes[b], strict=True):
            if b == planes.shape[0] - 1:
                out -= table[index]
            else:
                out += table[index]
    return out


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros to one width."""
    size = pc.list_value_length(column).to_numpy()
    flat = pc.list_flatten(column).to_numpy()
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values, null as 0, and whether they are null."""
    return column.fill_null(0).to_numpy(), np.asarray(column.is_null())


def _best(score: np.ndarray, chosen: np.ndarray, k: int) -> np.ndarray:
    """The k best of the chosen rows, which stand in order of their ids; equal scores in that order."""
    if len(chosen) > k:
        s = score[chosen]
        least = np.partition(s, len(s) - k)[len(s) - k]
        sure = np.flatnonzero(s > least)
        chosen = chosen[np.concatenate((sure, np.flatnonzero(s == least)[: k - len(sure)]))]
        chosen.sort()
    return chosen[np.argsort(-score[chosen], kind="stable")]


def _meet(k: int, low: int, high: int, per: int):
    """A block of anchors and a block of rows: the best positives of each anchor, or the negatives of each positive.

    anchors: akey, aid, alabel, avec and, in the second pass, tops (array of score, in order). rows: rkey, rid, rlabel, rvec.
    """

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        names = ("akey", "place", "score", "rid", "rkey")
        out: list[list] = [[] for _ in names]
        if anchors.num_rows and rows.num_rows:
            rid, none = _ids(rows["rid"])
            rows = rows.take(pa.array(np.lexsort((rows["rkey"].to_numpy(), rid, none))))
            (rid, none), label, rkey = _ids(rows["rid"]), rows["rlabel"].to_numpy(), rows["rkey"].to_numpy()
            width = -(-max(pc.max(pc.list_value_length(v)).as_py() for v in (anchors["avec"], rows["rvec"])) // 8) * 8
            planes = bit_planes(_matrix(rows["rvec"], width)) if width else np.zeros((1, 0, len(rid)), np.uint8)
            vectors, akey, alabel = _matrix(anchors["avec"], width), anchors["akey"].to_numpy(), anchors["alabel"].to_numpy()
            tops = anchors["tops"].to_pylist() if "tops" in anchors.column_names else None
            for first in range(0, len(akey), AT_A_TIME):
                found = scores(subset_sums(vectors[first : first + AT_A_TIME]), planes).T
                for i, score in enumerate(found, first):
                    score = np.ascontiguousarray(score)
                    if tops is None:
                        picked = [(0, _best(score, np.flatnonzero((label == alabel[i]) & (rkey != akey[i])), k))]
                    else:
                        picked = []
                        fits = np.flatnonzero((label != alabel[i]) & (score <= max(tops[i])) & (high * score.astype(np.int64) >= low * min(tops[i])))
                        for place, top in enumerate(tops[i], 1):
                            near = score[fits].astype(np.int64)
                            picked.append((place, _best(score, fits[(near <= top) & (high * near >= low * top)], per)))
                    for place, at in picked:
                        out[0].append(np.full(len(at), akey[i]))
                        out[1].append(np.full(len(at), place))
                        out[2].append(score[at].astype(np.int64))
                        out[3].append(np.where(none[at], np.iinfo(np.int64).min, rid[at]))
                        out[4].append(rkey[at])
        columns = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
        arrays = [pa.array(c, mask=c == np.iinfo(np.int64).min) if n == "rid" else pa.array(c) for n, c in zip(names, columns, strict=True)]
        return pa.table(dict(zip(names, arrays, strict=True)))

    return run


_MET = "akey long, place long, score long, rid long, rkey long"


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each anchor and each of its `positives` best rows of the same label: the `negatives` best rows of another label whose
    score is from low / high of the positive's to the positive's own.

    rows: (id long, label long, vector array<long>, anchor boolean). A score is the exact inner product; shorter vectors are
    filled up with zeros. Higher scores come first, then smaller ids; a null id counts as the greatest. An anchor is no positive of itself,
    but another row with its id is one. Rows with a null label or vector, or a null component, take no part.

    Returns anchor_id, positive_id, positive_rank, rank (from 1), negative_id, positive_score, negative_score. A positive
    without such rows has none; an empty table gives an empty result. Rows that share an id are taken one by one. Scores
    are longs: components whose products' sum cannot be one raise an error.
    """
    whole = rows.where("label is not null and vector is not null and not exists(vector, x -> x is null)")
    own = checkpoint(whole.select(F.monotonically_increasing_id().alias("key"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector", F.coalesce("anchor", F.lit(False)).alias("anchor")))
    found = own.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("vector")).alias("width"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).first()
    width, most = found["width"] or 0, found["most"] or 0
    if most < 0 or 4 * width * most * most * max(low, high) >= 2**63:
        raise ValueError("the scores of such components do not fit a long")
    blocks = max(1, -(-found["n"] // ROWS), min(2 * shuffle_width(rows), found["n"] // FEW_ROWS))
    groups = max(1, -(-found["anchors"] // ANCHORS))
    ship(rows.sparkSession)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = own.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), every(groups).alias("team"), F.col("key").alias("rkey"), F.col("id").alias("rid"), F.col("label").alias("rlabel"), F.col("vector").alias("rvec"))
    few = own.where("anchor").select(F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("team"), F.col("key").alias("akey"), F.col("id").alias("aid"), F.col("label").alias("alabel"), F.col("vector").alias("avec"))

    def met(asking: DataFrame) -> DataFrame:
        sent = asking.select("*", every(blocks).alias("block")).drop("aid")
        pairs = sent.groupBy("block", "team").cogroup(dealt.groupBy("block", "team"))
        return pairs.applyInArrow(_meet(positives, low, high, negatives), _MET)

    order = [F.col("score").desc(), F.col("rid").asc_nulls_last(), "rkey"]
    best = met(few).withColumn("n", F.row_number().over(Window.partitionBy("akey").orderBy(*order))).where(F.col("n") <= positives)
    tops = checkpoint(best.groupBy("akey").agg(F.array_sort(F.collect_list(F.struct("n", "score", "rid"))).alias("best")))
    asking = few.join(tops, "akey").withColumn("tops", F.col("best.score")).drop("best")
    near = met(asking).withColumn("rank", F.row_number().over(Window.partitionBy("akey", "place").orderBy(*order))).where(F.col("rank") <= negatives)
    named = near.join(tops.join(few.select("akey", "aid"), "akey"), "akey")
    mine = F.element_at("best", F.col("place").cast("int"))
    return named.select(F.col("aid").alias("anchor_id"), mine["rid"].alias("positive_id"), F.col("place").alias("positive_rank"), "rank", F.col("rid").alias("negative_id"), mine["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def quantized(embeddings: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows for hard_negatives(): each component x as floor(scale * x), x as a double. Rows with a null label or vector, or
    a null or non-finite component, are left out; an empty vector is one of zeros."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda v: v.cast("double"))
    fine = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), x.alias("x")).where("label is not null and x is not null").where(fine)
    return rows.select("id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("vector"))
