"""Suffix-array dedup of bytes: bucket-pointer refinement of the suffixes around shared anchors.

Sorting every suffix of a corpus at once would move each byte many times over. So windows are first dealt out by an
anchor: of the grams in a window, the one with the least hash. Equal windows have equal anchors, at the same offset. Runs
of neighbouring windows with one anchor form one piece of text, and only pieces count whose anchor occurs in several
documents. Where all pieces around an anchor are the same by their fingerprints, as within a long passage, the least
document has the original; where they differ but agree on a side of the anchor, as at a passage's ends, one piece of each
kind is fetched, and each group of pieces is suffix-sorted to the depth of a window: suffixes start in buckets of
equal 8-grams, and a bucket is refined by sorting on the bucket pointers that stand further on, again and again until it
is done; buckets that come later reuse the pointers refined before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, SliceHashes, arrow_map, broadcast_if_few, checkpoint, chunks, copies_of, flat_lists, gather_anchors, key_of, long_batch, mix, shared_anchors, shuffle_width, texts_of, with_rows

#: Bytes of pieces that are suffix-sorted together; a larger group of one anchor is sorted alone.
SORTED = 1 << 20

#: Parts in which a group's suffixes are refined one after the other.
PARTS = 8

#: Bits of an anchor's hash that pieces give up for their fingerprints, which have 64 more.
SPARE = 16
SPARE_MASK = np.uint64((1 << SPARE) - 1)

#: One document in so many is looked at for anchors that are in very many documents.
HOT_SAMPLE = 64

#: An anchor is in very many if it has this share of the rows of a task.
HOT_SHARE = 0.2


def _refine(active: np.ndarray, pointer: np.ndarray, known: np.ndarray, depth: int) -> int:
    """Refines whole buckets in place until each has one suffix or agrees on depth bytes; returns the number of rounds.

    The suffixes of a bucket agree on their first known bytes. They are sorted on the bucket pointers that stand so many
    bytes further on, as these are now; those that agree there, too, agree on what that bucket is known to agree on.
    """
    n, rounds = len(pointer), 0
    while len(active):
        rounds += 1
        step = known[active]
        ahead = active + step
        inside = ahead < n
        ahead = np.minimum(ahead, n - 1)
        first, second = pointer[active], np.where(inside, pointer[ahead] + 1, 0)
        deeper = step + np.where(inside, known[ahead], depth)
        order = np.argsort(first * (n + 1) + second, kind="stable")
        first, second, deeper, moved = first[order], second[order], deeper[order], active[order]
        at = np.arange(len(order))
        bucket = np.concatenate(([True], first[1:] != first[:-1]))
        new = bucket.copy()
        new[1:] |= second[1:] != second[:-1]
        start = np.maximum.accumulate(np.where(new, at, 0))
        pointer[moved] = first + start - np.maximum.accumulate(np.where(bucket, at, 0))
        known[moved] = deeper
        active = moved[(np.bincount(start, minlength=len(at))[start] > 1) & (deeper < depth)]
    return rounds


def suffix_buckets(data: np.ndarray, depth: int, parts: int = PARTS, rounds: list[int] | None = None) -> np.ndarray:
    """Bucket pointers of all suffixes of data, sorted by their first depth bytes (zeros follow the end).

    Suffixes have the same pointer if and only if those bytes are the same, and pointers are in their order.

    Suffixes start in buckets of equal grams. These are refined part by part, each to its end before the next one, on
    pointers that the same pass has refined already; so a pointer may tell more than depth bytes, and at the end
    neighbours that do not differ before are compared byte by byte and joined again. rounds gets the rounds of each part.
    """
    n, q = len(data), min(8, depth)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate((data, np.zeros(depth + 16, np.uint8)))
    gram = np.zeros(n + depth, np.uint64)
    for k in range(q):
        gram = (gram << np.uint64(8)) | padded[k : k + n + depth]
    order = np.argsort(gram[:n], kind="stable")
    new = np.concatenate(([True], gram[order[1:]] != gram[order[:-1]]))
    pointer, known = np.empty(n, np.int64), np.full(n, q, np.int64)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    pointer[order] = start
    if q < depth:
        several = np.bincount(start, minlength=n)[start] > 1
        cuts = np.unique(np.append(start[np.arange(parts) * n // parts], n))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            done = _refine(order[s:e][several[s:e]], pointer, known, depth)
            if rounds is not None:
                rounds.append(done)
        order = np.argsort(pointer, kind="stable")
        one, two = order[:-1], order[1:]
        same = pointer[one] == pointer[two]
        open_ = np.flatnonzero(~same & (gram[one] == gram[two]))
        for k in sorted({*range(8, depth - 8, 8), depth - 8} - {0}):
            open_ = open_[gram[one[open_] + k] == gram[two[open_] + k]]
        same[open_] = True
        new = np.concatenate(([True], ~same))
        pointer[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return pointer


def gram_size(window: int) -> int:
    return max(1, min(16, window // 3))


class Minimizers:
    """The anchors of all windows of some texts, joined in one byte string."""

    def __init__(self, texts: list[bytes], window: int):
        q = gram_size(window)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.text = b"".join(texts)
        self.first = np.cumsum(sizes) - sizes
        self.sizes = sizes
        n = len(self.text)
        data = np.frombuffer(self.text + bytes(32), np.uint8)
        m = max(n - q + 1, 0)
        eight = np.empty(n + 24, np.uint64)
        for k in range(8):
            there = np.frombuffer(data, "<u8", count=(len(data) - k) // 8, offset=k)
            part = eight[k::8]
            part[:] = there[: len(part)]
        if q < 8:
            self.hashes = mix(eight[:m] & np.uint64((1 << 8 * q) - 1))
        else:
            h = eight[:m] * np.uint64(0x9E3779B97F4A7C15)
            for k in {*range(8, q - 8, 8), q - 8} - {0}:
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F) ^ eight[k : k + m]
            self.hashes = mix(h)
        #: The place of the anchor of the window at each byte, and whether a whole window of one text begins there.
        count = max(n - window + 1, 0)
        bits = np.uint64(32)  # the first of the grams with the least upper half, however many texts stand here together
        least = (self.hashes >> bits << bits) | np.arange(m, dtype=np.uint64)
        span, width = 1, window - q + 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: span - width], least[width - span :])
        self.anchor = (least[:count] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        left = np.repeat(self.first + sizes, sizes) - np.arange(n)
        self.fits = left[:count] >= window

    def runs(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last windows of each run of chosen windows with one anchor in one text."""
        at = np.flatnonzero(chosen)
        if not len(at):
            return at, at
        cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (self.anchor[at[1:]] != self.anchor[at[:-1]]) | (self.doc[at[1:]] != self.doc[at[:-1]]))
        return at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))]


def _anchors(window: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(), texts_of(b.column(1))
            for k, end in chunks(map(len, texts)):
                found = Minimizers(texts[k:end], window)
                first, _ = found.runs(found.fits)
                if len(first):
                    yield found.hashes[found.anchor[first]], ids[k:end][found.doc[first]]

    return lambda batches: gather_anchors(blocks(batches), repeats_count=False)


def _shared_windows(found: Minimizers, hs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the window at each byte has an anchor among its document's shared hashes."""
    out = found.fits.copy()
    first, last = found.runs(found.fits)
    golden = np.uint64(0x9E3779B97F4A7C15)
    mine = hs.view(np.uint64) + np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64) * golden
    ok = np.isin((found.hashes[found.anchor[first]] & ~np.uint64(1)) + found.doc[first].astype(np.uint64) * golden, mine)
    edge = np.zeros(len(out) + 1, np.int64)
    edge[first[~ok]] += 1
    np.subtract.at(edge, last[~ok] + 1, 1)
    out[np.cumsum(edge[:-1]) > 0] = False
    return out


def _pieces(window: int, hot: np.ndarray):
    """Pieces as (h, print, doc, run, row): anchor, fingerprint, id, run, and row.

    The lower SPARE bits of h are no part of the anchor: they and print are the fingerprint, of two independent hashes.
    run = first window << 32 | left << 22 | right << 12 | number of windows. left and right are 10-bit fingerprints of what
    stands on each side of the anchor, half of a window's other bytes long. Two pieces that share a window agree in one of them.
    """
    q = gram_size(window)
    half = (window - q + 1) // 2

    def combined(parts: list[tuple]) -> pa.RecordBatch:
        """Of equal pieces of this block, those of the least document: the others' windows surely occur before."""
        return long_batch(**dict(zip(("h", "print", "doc", "run", "row"), _least(*(np.concatenate(x) for x in zip(*parts, strict=True))), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            rows, texts, docs = batch.column(0).to_numpy(), texts_of(batch.column(1)), batch.column(5).to_numpy()
            hs, sizes = flat_lists(batch.column(2))
            ends = np.cumsum(sizes)
            for k, end in chunks(map(len, texts)):
                found = Minimizers(texts[k:end], window)
                first, last = found.runs(_shared_windows(found, hs[ends[k] - sizes[k] : ends[end - 1]], sizes[k:end]))
                if not len(first):
                    continue
                data = np.frombuffer(found.text, np.uint8)
                prints = SliceHashes(data)
                h = found.hashes[found.anchor[first]] & ~np.uint64(1)
                each = np.isin(h, hot)
                if each.any():  # an anchor in very many documents: each of its windows goes by itself
                    width = np.where(each, last - first + 1, 1)
                    inner = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                    each, h, last = np.repeat(each, width), np.repeat(h, width), np.repeat(last, width)
                    first = np.repeat(first, width) + inner
                    last = np.where(each, first, last)
                doc = found.doc[first]
                begin, end_ = found.first[doc], found.first[doc] + found.sizes[doc]
                anchor = found.anchor[first]
                left = (prints(np.maximum(anchor - half, begin), anchor) >> np.uint64(54)).astype(np.int64)
                right = (prints(anchor + q, np.minimum(anchor + q + half, end_)) >> np.uint64(54)).astype(np.int64)
                run = ((first - begin) << 32) | (left << 22) | (right << 12) | (last - first + 1)
                one = prints(first, last + window)
                del prints
                two = SliceHashes(data, 1)(first, last + window)
                h, two = np.where(each, one, (h & ~SPARE_MASK) | (two >> np.uint64(64 - SPARE))), np.where(each, two, one)
                parts.append((h, two, docs[k:end][doc], run, rows[k:end][doc]))
                n += len(first)
                if n >= BLOCK:
                    yield combined(parts)
                    parts, n = [], 0
        if parts:
            yield combined(parts)

    return run


def _least(h: np.ndarray, prints: np.ndarray, doc: np.ndarray, run: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pieces with one anchor and fingerprint, those of the least id, in order of these."""
    order = np.lexsort((doc, prints, h))
    h, prints, doc, run, row = h[order], prints[order], doc[order], run[order], row[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (prints[1:] != prints[:-1])))
    keep = doc == doc[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    return h[keep], prints[keep], doc[keep], run[keep], row[keep]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition of pieces: (row, run, ask), run = first window << 16 | number of windows.

    ask is null where the run is original: no other piece around its anchor agrees with it on a side. Else it is the anchor.
    """
    parts = [tuple(c.to_numpy() for c in b.columns) for b in batches]
    if not parts:
        return
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    del parts
    h, prints, _, run, row = _least(*columns)
    del columns
    h = h.view(np.uint64)
    anchor = h >> np.uint64(SPARE)
    ask = np.zeros(len(h), bool)
    for shift in (22, 12):
        side = (run >> shift) & 1023
        order = np.lexsort((h, prints, side, anchor))
        a, b, c, d = anchor[order], side[order], prints[order], h[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        kinds = np.bincount(np.cumsum(new) - 1, weights=np.concatenate(([True], new[1:] | (c[1:] != c[:-1]) | (d[1:] != d[:-1]))))
        ask[order] |= kinds[np.cumsum(new) - 1] > 1
    run = (run >> 32 << 16) | (run & 4095)
    for k in range(0, len(h), 200_000):
        part = slice(k, k + 200_000)
        asked = pa.array(anchor[part].view(np.int64), mask=~ask[part])
        yield pa.RecordBatch.from_arrays([pa.array(row[part]), pa.array(run[part]), asked], names=["row", "run", "ask"])


def _fetched(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            route, pieces, doc, at, row = [], [], [], [], []
            for r, text, asks, copy, d in zip(rows, texts, batch.column(2).to_pylist(), batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                for a in [] if copy else asks:
                    start, n = a["run"] >> 16, a["run"] & 0xFFFF
                    route.append(a["ask"]), pieces.append(text[start : start + n + window - 1]), doc.append(d), at.append(start), row.append(r)
            longs = [pa.array(x, pa.int64()) for x in (doc, at, row)]
            yield pa.RecordBatch.from_arrays([pa.array(route, pa.int64()), pa.array(pieces, pa.binary()), *longs], names=["route", "piece", "doc", "start", "row"])

    return run


def _originals_of(data: np.ndarray, size: np.ndarray, doc: np.ndarray, at: np.ndarray, row: np.ndarray, window: int) -> pa.RecordBatch:
    """Runs of windows that are in no piece of a smaller id."""
    pointer = suffix_buckets(data, window)
    begin = np.cumsum(size) - size
    count = size - window + 1
    piece = np.repeat(np.arange(len(size)), count)
    inner = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    bucket, whose = pointer[begin[piece] + inner], doc[piece]
    order = np.lexsort((whose, bucket))
    lead = np.concatenate(([True], bucket[order][1:] != bucket[order][:-1]))
    least = np.empty(len(order), np.int64)
    least[order] = whose[order][np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
    own = np.flatnonzero(least == whose)
    if not len(own):
        return long_batch(row=own, run=own)
    cut = np.flatnonzero((own[1:] != own[:-1] + 1) | (piece[own[1:]] != piece[own[:-1]]))
    first, last = own[np.concatenate(([0], cut + 1))], own[np.concatenate((cut, [len(own) - 1]))]
    # a run is at most a window long: its length fits the low 16 bits
    return long_batch(row=row[piece[first]], run=((at[piece[first]] + inner[first]) << 16) | (last - first + 1))


def _originals(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by route; whole routes of about SORTED bytes are handled at a time."""
        held: list[pa.RecordBatch] = []
        total = 0
        for b in batches:
            while b.num_rows:
                held.append(b)
                total += b.column(1).nbytes
                b = b.slice(b.num_rows)
                if total < SORTED:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                route = table.column(0).to_numpy()
                cut = int(np.searchsorted(route, route[-1]))
                if cut:
                    yield from groups(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                total = sum(x.column(1).nbytes for x in held) if cut else 0
        if held:
            yield from groups(pa.Table.from_batches(held))

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        route = table.column(0).to_numpy()
        pieces = [x for c in table.column(1).chunks for x in c.to_pylist()]
        doc, at, row = (table.column(k).to_numpy() for k in (2, 3, 4))
        size = np.array([len(x) for x in pieces], np.int64)
        new = np.flatnonzero(np.concatenate(([True], route[1:] != route[:-1])))
        ends = np.append(new[1:], len(route))
        for k, end in chunks((int(size[s:e].sum()) for s, e in zip(new, ends, strict=True)), SORTED):
            s, e = new[k], ends[end - 1]
            yield _originals_of(np.frombuffer(b"".join(pieces[s:e]), np.uint8), size[s:e], doc[s:e], at[s:e], row[s:e], window)

    return run


def _removal(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(0))
            (hs, sizes), (runs, run_sizes) = flat_lists(batch.column(1)), flat_lists(batch.column(2))
            copy = np.array(batch.column(3).to_pylist(), bool)
            ends, run_ends = np.cumsum(sizes), np.cumsum(run_sizes)
            kept, spans = [], []
            for k, end in chunks(map(len, texts)):
                if not sizes[k:end].any() and not copy[k:end].any():
                    kept += texts[k:end]
                    spans += [[]] * (end - k)
                    continue
                found = Minimizers(texts[k:end], window)
                repeated = _shared_windows(found, hs[ends[k] - sizes[k] : ends[end - 1]], sizes[k:end])
                mine = runs[run_ends[k] - run_sizes[k] : run_ends[end - 1]]
                begin = np.repeat(found.first, run_sizes[k:end]) + (mine >> 16)
                edge = np.zeros(len(repeated) + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.subtract.at(edge, begin + (mine & 0xFFFF), 1)
                repeated &= np.cumsum(edge[:-1]) == 0
                repeated |= copy[k:end][found.doc[: len(repeated)]] & found.fits
                at = np.flatnonzero(repeated)
                edge = np.zeros(len(found.text) + 1, np.int64)
                edge[at] += 1
                np.subtract.at(edge, at + window, 1)
                gone = np.cumsum(edge[:-1]) > 0
                data = np.frombuffer(found.text, np.uint8)
                for first, n in zip(found.first.tolist(), found.sizes.tolist(), strict=True):
                    mask = gone[first : first + n]
                    if not mask.any():
                        kept.append(found.text[first : first + n])
                        spans.append([])
                        continue
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                    kept.append(data[first : first + n][~mask].tobytes())
                    spans.append([{"begin": b, "end": e} for b, e in turn.reshape(-1, 2).tolist()])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(list(map(len, texts)), pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=["id", "n_bytes", "kept", "spans"])

    return run


def _occurrences(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(0))
            for k, end in chunks(map(len, texts)):
                found = Minimizers(texts[k:end], window)
                h, n = np.unique(found.hashes[found.anchor[found.runs(found.fits)[0]]] & ~np.uint64(1), return_counts=True)
                yield long_batch(h=h, n=n)

    return run


def hot_anchors(docs: DataFrame, window: int, share: float) -> np.ndarray:
    """Anchors with about `share` of a task's pieces or more, by a sample; only how work is dealt out depends on them.

    There are at most as many as tasks divided by share.
    """
    sample = docs.where(F.pmod(F.crc32(F.col("doc").cast("string").cast("binary")), F.lit(HOT_SAMPLE)) == 0)
    counts = checkpoint(arrow_map(sample.select("body"), _occurrences(window), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= max(2, share * total / shuffle_width(docs))).select("h").collect()
    return np.array([r["h"] for r in rows], np.int64).view(np.uint64)


def suffix_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: float = HOT_SHARE) -> DataFrame:
    """Removes each byte covered by `window` bytes that also start in a document with a smaller id.

    Texts are UTF-8 bytes; a match never crosses documents. Strings are judged on the input; repeats within a document
    stay. Pieces around an anchor with about the share `hot` of a task's rows or more are dealt out window by window.

    Returns id_col, n_bytes, kept (binary: the bytes left; they may cut a character), spans (array of begin, end:
    maximal removed runs in bytes). A null text is empty and loses nothing, as does one shorter than the window. A null
    id is smaller than all others. Rows that share an id, or have none, are documents by themselves that lose nothing to
    each other, as none has the smaller id; so repeated rows fare alike. Long texts are taken whole, and an empty table has
    an empty result. Other columns are ignored, whatever their names.
    """
    if not 1 <= window < 4096:
        raise ValueError("window must be from 1 to 4095 bytes")
    full = with_rows(docs.select(key_of(F.col(f"`{id_col}`")).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("body"), F.col(f"`{id_col}`").alias("id")))
    copies = broadcast_if_few(copies_of(full))
    firsts_only = full.join(copies, ["doc", "print"], "left_anti").select("row", "body")
    hs = shared_anchors(arrow_map(firsts_only, _anchors(window), "h long, doc long")).withColumnRenamed("doc", "row")
    # all uses of the texts have the same columns and filters, so that Spark shuffles them once; copies have no hs
    joined = full.join(copies, ["doc", "print"], "left").join(hs, "row", "left").select("row", "body", "hs", "id", F.col("copy").isNotNull().alias("copy"), "doc")
    hot_ = hot_anchors(full.select("doc", "body"), window, hot)
    pieces = arrow_map(joined.where("hs is not null"), _pieces(window, hot_), "h long, print long, doc long, run long, row long")
    settled = arrow_map(pieces.repartition(shuffle_width(docs), F.shiftrightunsigned("h", SPARE)), _settled, "row long, run long, ask long")
    runs = settled.groupBy("row").agg(F.collect_list(F.when(F.col("ask").isNull(), F.col("run"))).alias("runs"), F.collect_list(F.when(F.col("ask").isNotNull(), F.struct("ask", "run"))).alias("asks"))
    told = joined.join(runs, "row", "left")
    fetched = arrow_map(told.where("size(asks) > 0").select("row", "body", "asks", "hs", "id", "runs", "copy", "doc"), _fetched(window), "route long, piece binary, doc long, start long, row long")
    dealt = fetched.repartition(shuffle_width(docs), "route").sortWithinPartitions("route")
    more = arrow_map(dealt, _originals(window), "row long, run long").groupBy("row").agg(F.collect_list("run").alias("more"))
    last = told.join(more, "row", "left").withColumn("runs", F.concat(F.coalesce("runs", F.array()), F.coalesce("more", F.array()))).select("body", "hs", "runs", "copy", "id", "asks", "doc")
    kind = last.schema["id"].dataType.simpleString()
    out = arrow_map(last, _removal(window), f"id {kind}, n_bytes long, kept binary, spans array<struct<begin: long, end: long>>")
    return out.select(F.col("id").alias(id_col), "n_bytes", "kept", "spans")
