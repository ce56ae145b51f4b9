"""MinHash near-dedup: many universal hash minima, banding, verification, components by large-star and small-star.

Rows with the same text are one class, of which one row goes on as a node. Band buckets link each node to the bucket's
least one; pairs that their signatures hold likely are confirmed on full shingle sets. What a bucket then still holds of
different components is compared on signatures, in blocks, which yields regions: nodes that likely pairs connect. Texts
of a region meet in blocks, once, however many buckets the nodes share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import forget, written
from .common import Words, arrow_map, broadcast_if_few, checkpoint, chunks, key_of, shuffle_width, texts_of

#: 1 - (1 - 0.8 ** 7) ** 48: a pair of similarity 0.8 shares a bucket but for one case in 10**5, of 0.85 in 10**8.
ROWS, BANDS = 7, 48

#: Signatures of a bucket that are compared with each other in one group.
MEMBERS = 2048

#: Texts of a region that are compared with each other in one group, and the bytes by which a long one counts as several.
TEXTS, TEXT_BYTES = 512, 2048

#: Leaves that are compared with their hub in one group.
LEAVES = 1000

#: Links of a task, so that small graphs do not spread over as many tasks as large ones.
LINKS = 50_000

#: Standard errors by which an estimate may fall short of the similarity asked for: one pair in 10**6 falls shorter.
ERRORS = 4.75


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(9)
    return (rng.integers(0, 2**32, n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32), rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each universal hash a * x + b modulo 2**32, its least value over x."""
    out = np.full(len(a), 2**32 - 1, np.uint32)
    room = np.empty((min(len(x), 128), len(a)), np.uint32)
    for k in range(0, len(x), 128):
        part = x[k : k + 128]
        np.multiply(part[:, None], a, out=room[: len(part)])
        room[: len(part)] += b
        np.minimum(out, np.minimum.reduce(room[: len(part)], axis=0), out=out)
    return out


def shingle_hashes(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of fewer words, of the whole."""
    words = Words(texts)
    at = np.flatnonzero(words.left >= n)
    grams = words.grams(at, n)
    begin = np.cumsum(np.maximum(words.counts - n + 1, 0))
    out = []
    for k, (first, count) in enumerate(zip(words.first.tolist(), words.counts.tolist(), strict=True)):
        if count >= n:
            out.append(np.unique(grams[begin[k] - count + n - 1 : begin[k]]))
        else:
            out.append(words.grams(np.array([first]), count) if count else np.zeros(0, np.uint64))
    return out


def _signatures(n: int, rows: int, bands: int):
    a, b = _coefficients(rows * bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.lower() for t in texts_of(batch.column(2))]
            sizes, buckets, marks = [], [], []
            for k, end in chunks(map(len, texts)):
                for x in shingle_hashes(texts[k:end], n):
                    sizes.append(len(x))
                    if not len(x):
                        buckets.append(None), marks.append(None)
                        continue
                    least = minima((x >> np.uint64(32)).astype(np.uint32), a, b)
                    buckets.append([xxhash.xxh3_64_intdigest(least[i * rows : i * rows + rows].tobytes(), i) - 2**63 for i in range(bands)])
                    marks.append((least >> np.uint32(8)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(buckets, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=["id", "same", "n_shingles", "buckets", "marks"],
            )

    return run


def _agree(one: pa.Array, two: pa.Array) -> np.ndarray:
    """Share of equal signature bytes, for each row."""
    x = np.frombuffer(b"".join(one.to_pylist()), np.uint8).reshape(len(one), -1)
    return (x == np.frombuffer(b"".join(two.to_pylist()), np.uint8).reshape(len(two), -1)).mean(1)


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_agree(b.column("ma"), b.column("mb")) >= least)).select(["a", "b"])

    return run


def _shingles(text: bytes, n: int) -> set[bytes]:
    w = text.lower().split()
    return {b" ".join(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))}


def _linked(x: set[bytes], y: set[bytes], percent: int) -> bool:
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _star_links(percent: int, n: int):
    """Rows (a, part, leaf, node, body), sorted: a hub's text, then its leaves'. Links between those whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set[bytes] = set()
        for batch in batches:
            hubs, leaves = [], []
            for a, leaf, node, text in zip(batch.column("a").to_pylist(), batch.column("leaf").to_pylist(), batch.column("node").to_pylist(), texts_of(batch.column("body")), strict=True):
                if not leaf:
                    own = _shingles(text, n)
                elif _linked(own, _shingles(text, n), percent):
                    hubs.append(a), leaves.append(node)
            yield _pairs(hubs, leaves)

    return run


class _Held:
    """Rows of one group that the rows that follow are compared with."""

    def __init__(self, width: int):
        self.n, self.width, self.texts, self.sets = 0, width, [], {}
        self.marks, self.columns = np.empty((64, width), np.uint8), np.empty((4, 64), np.int64)

    def add(self, marks: np.ndarray, node: int, comp: int, size: int, label: int, text: bytes | None) -> None:
        if self.n == len(self.marks):
            self.marks = np.concatenate((self.marks, np.empty_like(self.marks)))
            self.columns = np.concatenate((self.columns, np.empty_like(self.columns)), axis=1)
        self.marks[self.n], self.columns[:, self.n] = marks, (node, comp, size, label)
        self.texts.append(text)
        self.n += 1

    def near(self, marks: np.ndarray, comp: int, size: int, label: int, least: float, percent: int) -> np.ndarray:
        """Rows of other components and labels that may be alike by size and signature."""
        _, comps, sizes, labels = self.columns[:, : self.n]
        at = np.flatnonzero((comps != comp) & (labels != label) & (100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)))
        return at[(self.marks[at] == marks).mean(1) >= least] if len(at) else at

    def shingles(self, k: int, n: int) -> set[bytes]:
        if k not in self.sets:
            self.sets[k] = _shingles(self.texts[k], n)
        return self.sets[k]


def _block_links(least: float, percent: int, n: int, confirm: bool):
    """Rows (key, lo, hi, side, node, comp, size, marks[, body]), sorted: those of side 0, then those of side 1.

    Compares both sides, or where there is but side 0, its rows with each other. Yields a spanning set of links:
    confirm: between components, of pairs whose sets are alike; else between nodes of different components, of likely
    pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, merged = None, _Held(0), {}

        def name(x: int) -> int:
            while x in merged:
                x = merged[x]
            return x

        for batch in batches:
            found: tuple[list[int], list[int]] = ([], [])
            groups = zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi")), strict=True)
            rows = zip(groups, *(batch.column(c).to_pylist() for c in ("side", "node", "comp", "size", "marks")), texts_of(batch.column("body")) if confirm else [None] * batch.num_rows, strict=True)
            for group, side, node, comp, size, raw, text in rows:
                if group != key:
                    key, held, merged = group, _Held(len(raw)), {}
                marks = np.frombuffer(raw, np.uint8)
                label, own = name(comp if confirm else node), None
                if side or group[1] == group[2]:
                    for k in held.near(marks, comp, size, label, least, percent).tolist():
                        other = int(held.columns[3, k])
                        if other == label:
                            continue
                        if confirm:
                            own = own or _shingles(text, n)
                            if not _linked(own, held.shingles(k, n), percent):
                                continue
                        found[0].append(int(held.columns[0, k])), found[1].append(node)
                        labels = held.columns[3, : held.n]
                        labels[labels == other] = label
                        merged[other] = label
                if not side:
                    held.add(marks, node, comp, size, label, text)
                    if own:
                        held.sets[held.n - 1] = own
            yield _pairs(*found)

    return run


def _tasks(df: DataFrame, rows: int) -> DataFrame:
    """df in no more tasks than its rows need."""
    return df.coalesce(max(1, min(shuffle_width(df), -(-rows // LINKS))))


def connected_components(links: DataFrame) -> DataFrame:
    """links: (a, b). Returns (doc, comp) for each linked doc, comp the least id that it reaches.

    Alternates large-star (neighbours above a node go to its least neighbour) and small-star (those below it do, and
    itself) until no node has neighbours on both sides, nor two below. The nodes for which a step changes anything are
    written first, so that the join with the links is of two plain tables, of which Spark splits a hot hub.
    """
    spark, paths = links.sparkSession, []

    def kept(df: DataFrame, rows: int) -> DataFrame:
        table, path = written(_tasks(df.distinct(), rows), "edges")
        paths.append(path)
        return table

    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")), links.count())
    while True:
        n = edges.count()
        ends = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("e")).select("e.u", "e.v")
        middle = checkpoint(_tasks(ends.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x")).where("m < u and x > u").select(F.col("u").alias("lo"), "m"), n))
        above = not middle.isEmpty()
        if above:
            edges = kept(edges.join(broadcast_if_few(middle), "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo")), n)
        several = checkpoint(_tasks(edges.groupBy("hi").agg(F.min("lo").alias("m"), F.max("lo").alias("x")).where("m < x").select("hi", "m"), n))
        below = not several.isEmpty()
        if below:
            both = edges.join(broadcast_if_few(several), "hi", "left").withColumn("m", F.coalesce("m", "lo"))
            star = both.select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo")
            edges = kept(star.where("hi <> lo"), n)
        for path in paths[:-1]:
            forget(spark, path)
        del paths[:-1]
        if not above and not below:
            break
    return edges.select(F.col("hi").alias("doc"), F.col("lo").alias("comp")).unionByName(edges.select(F.col("lo").alias("doc"), F.col("lo").alias("comp")).distinct())


def _texts(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes: (node, doc, same), checkpointed. Returns (node, body): a text for each, found by id and digest."""
    met = own.join(broadcast_if_few(nodes, 3), "doc").where(F.unhex(F.sha2("body", 256)) == F.col("same"))
    return met.groupBy("node").agg(F.first("body").alias("body"))


def _confirmed(pairs: DataFrame, lead: DataFrame, own: DataFrame, percent: int, n: int) -> DataFrame:
    """pairs: (a, b), checkpointed, of hubs and leaves. Those whose full shingle sets are alike.

    A hub's leaves are dealt out in parts, and its text goes once to each part.
    """
    count = pairs.count()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = checkpoint(lead.select("node", "doc", "same").join(broadcast_if_few(checkpoint(_tasks(ids, count))), "node", "left_semi"))
    texts = _texts(own, nodes)
    parts = checkpoint(_tasks(pairs.groupBy("a").agg(F.ceil(F.count("*") / LEAVES).cast("int").alias("parts")), count))
    small = broadcast_if_few(parts)
    leaves = pairs.join(small, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("leaf"), F.col("b").alias("node"))
    hubs = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("leaf"), F.col("a").alias("node"))
    met = leaves.unionByName(hubs).join(texts, "node").select("a", "part", "leaf", "node", "body")
    dealt = met.repartition(shuffle_width(pairs), "a", "part").sortWithinPartitions("a", "part", "leaf")
    return checkpoint(_tasks(arrow_map(dealt, _star_links(percent, n), "a long, b long"), 100 * count))


def _dealt(members: DataFrame, most: int) -> DataFrame:
    """members: (key, node, comp, weight, ...), checkpointed. Deals the members of a key out in groups (lo, hi) in which
    any two of different components meet: adds lo, hi and side.

    A key of up to `most` weight is one group. Of a larger one, a component of more than that has blocks of its own,
    which need no comparison with each other; the others share blocks. Each member goes to a group for each block that
    its own is to be compared with.
    """
    none = F.lit(0).cast("long")
    total = members.groupBy("key").agg(F.sum("weight").alias("weight")).where(F.col("weight") > most).select("key")
    large = checkpoint(total)
    if large.isEmpty():
        return members.withColumns({"lo": none, "hi": none, "side": F.lit(0)})
    wide = broadcast_if_few(large)
    small = members.join(wide, "key", "left_anti").withColumns({"lo": none, "hi": none, "side": F.lit(0)})
    sizes = members.join(wide, "key").groupBy("key", "comp").agg(F.sum("weight").alias("weight"))
    parts = sizes.groupBy("key", F.when(F.col("weight") > most, F.col("comp")).alias("own")).agg(F.ceil(F.sum("weight") / most).cast("long").alias("blocks"))
    of_key = Window.partitionBy("key")
    start = F.sum("blocks").over(of_key.orderBy(F.col("own").asc_nulls_first())) - F.col("blocks")
    parts = checkpoint(parts.select("key", "own", "blocks", start.alias("start"), F.sum("blocks").over(of_key).alias("all")))
    alone = parts.where("own is not null").select("key", F.col("own").alias("comp"), F.col("blocks").alias("b"), F.col("start").alias("s"), F.lit(True).alias("alone"))
    common = parts.groupBy("key").agg(F.max("all").alias("all"), F.max(F.when(F.col("own").isNull(), F.col("blocks"))).alias("pool"))
    placed = members.join(wide, "key").join(broadcast_if_few(checkpoint(alone)), ["key", "comp"], "left").join(broadcast_if_few(checkpoint(common)), "key")
    at = F.coalesce("s", none) + F.pmod(F.xxhash64("node"), F.coalesce("b", "pool"))
    span = lambda a, b: F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<bigint>"))
    last = F.col("all") - 1
    others = F.when(F.col("alone"), F.concat(span(none, F.col("s") - 1), span(F.col("s") + F.col("b"), last))).otherwise(span(none, last))
    out = placed.withColumn("at", at).withColumn("other", F.explode(others))
    out = out.withColumns({"lo": F.least("at", "other"), "hi": F.greatest("at", "other"), "side": F.when(F.col("at") <= F.col("other"), 0).otherwise(1)})
    return small.unionByName(out.select(small.columns))


def _by_group(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("key", "lo", "hi", "side", *columns).repartition(shuffle_width(rows), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side")


def _rest(members: DataFrame, comps: DataFrame, lead: DataFrame, own: DataFrame, least: float, percent: int, n: int) -> DataFrame | None:
    """Links within a bucket and between different components that the first round has not met; None if there are none.

    Buckets with the very same members are looked at once.
    """
    few = broadcast_if_few(comps)
    held = members.join(few, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = held.groupBy("bucket").agg(F.min("comp").alias("first"), F.max("comp").alias("last"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    mixed = checkpoint(mixed.where("first <> last and n > 2").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"))
    if mixed.isEmpty():
        return None
    signed = checkpoint(held.join(broadcast_if_few(mixed), "bucket").select(F.col("bucket").alias("key"), "node", "comp", F.lit(1).alias("weight")))
    marks = lead.select("node", "marks", F.col("n_shingles").alias("size"))
    groups = _by_group(_dealt(signed, MEMBERS).join(marks, "node"), ["node", "comp", "size", "marks"])
    likely = checkpoint(_tasks(arrow_map(groups, _block_links(least, percent, n, False), "a long, b long").distinct(), signed.count()))
    if likely.isEmpty():
        return None
    regions = checkpoint(connected_components(likely).withColumnsRenamed({"doc": "node", "comp": "key"}))
    mine = lead.join(broadcast_if_few(regions), "node").join(few, "node", "left").select("key", "node", "doc", "same", F.coalesce("comp", "node").alias("comp"), "marks", F.col("n_shingles").alias("size"))
    mine = checkpoint(mine)
    told = checkpoint(mine.join(_texts(own, mine.select("node", "doc", "same")), "node").select("key", "node", "comp", "size", "marks", "body", (F.octet_length("body") / TEXT_BYTES + 1).cast("int").alias("weight")))
    groups = _by_group(_dealt(told, TEXTS), ["node", "comp", "size", "marks", "body"])
    return checkpoint(_tasks(arrow_map(groups, _block_links(least, percent, n, True), "a long, b long"), regions.count()))


def near_duplicates(docs: DataFrame, percent: int = 80, n: int = 5, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Links documents whose sets of n-word shingles have 100 * intersection >= percent * union; groups linked ones.

    A-Z are lower-cased; words are runs of other characters than space and \\x09-\\x0D. A text of fewer words is one
    shingle; one without words, or null, has none and is linked with nothing. Texts of any length are taken whole.

    Returns a row for each row of docs: id_col, n_shingles (of this row's text), component_id (the least id reachable,
    itself included), kept (id = component_id). Ids are whole numbers. A null id stands for the least long and its
    component_id is that. Rows that share an id, or have none, are one document: what links to any of their texts links
    to all. An empty table has an empty result. Ties do not matter, as all links count. Other columns are ignored,
    whatever their names.
    """
    body = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(body, 256)).alias("same"), body.alias("body"))
    kind = own.schema["id"].dataType.simpleString()
    signed = arrow_map(own, _signatures(n, rows, bands), f"id {kind}, same binary, n_shingles long, buckets array<long>, marks binary")
    signed = checkpoint(signed.withColumn("row", F.monotonically_increasing_id()).withColumn("doc", key_of("id")))
    own = own.select(key_of("id").alias("doc"), "body")

    first = F.min(F.struct("doc", "row"))
    classes = signed.where("n_shingles > 0").groupBy("same").agg(F.count("*").alias("n"), first.alias("f")).where("n > 1")
    classes = broadcast_if_few(checkpoint(classes.select("same", F.col("f.row").alias("first_row"), F.col("f.doc").alias("first_doc"))), 3)
    placed = signed.join(classes, "same", "left").withColumn("node", F.coalesce("first_row", "row"))
    lead = placed.where("n_shingles > 0 and node = row").select("node", "doc", "same", "n_shingles", "buckets", "marks")

    entries = lead.select("node", F.explode("buckets").alias("bucket"))
    hubs = checkpoint(entries.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub"))
    members = entries.join(broadcast_if_few(hubs), "bucket")
    share = percent / 100
    least = share - ERRORS * (share * (1 - share) / (rows * bands)) ** 0.5
    star = checkpoint(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    side = lambda x: lead.select(F.col("node").alias(x), F.col("marks").alias(f"m{x}"), F.col("n_shingles").alias(f"s{x}"))
    sized = star.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("sa", "sb") >= percent * F.greatest("sa", "sb"))
    links = _confirmed(checkpoint(arrow_map(sized, _likely(least), "a long, b long")), lead, own, percent, n)
    links = links.unionByName(_shared_ids(placed))
    comps = checkpoint(connected_components(links).withColumnRenamed("doc", "node"))
    more = _rest(members.select("bucket", "node"), comps, lead, own, least, percent, n)
    if more is not None and not more.isEmpty():
        comps = checkpoint(connected_components(links.unionByName(more)).withColumnRenamed("doc", "node"))

    few = broadcast_if_few(comps)
    named = placed.select("node", "doc").join(few, "node").groupBy("comp").agg(F.min("doc").alias("component_id"))
    ids = checkpoint(comps.join(checkpoint(named), "comp").select("node", "component_id"))
    out = placed.join(broadcast_if_few(ids), "node", "left").withColumn("component_id", F.coalesce("component_id", "first_doc", "doc"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("doc") == F.col("component_id")).alias("kept"))


def _shared_ids(placed: DataFrame) -> DataFrame:
    """placed: (doc, node). Links between the nodes of rows that share an id: (a, b), checkpointed."""
    shared = checkpoint(placed.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc", "a"))
    return checkpoint(placed.select("doc", "node").join(broadcast_if_few(shared), "doc").where("a < node").select("a", F.col("node").alias("b")).distinct())
