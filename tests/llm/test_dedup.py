"""Byte, word and document dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from turnloom.llm import common, minhash, substring, suffixes
from turnloom.llm.minhash import connected_components, near_duplicates
from turnloom.llm.substring import COVERS, substring_dedup
from turnloom.llm.suffixes import suffix_buckets, suffix_dedup

SCHEMA = "doc_id long, text string, spans string, doc string, hs int"  # names that clash with inner ones


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA).repartition(3)


def made_up(seed, n=40, words=60):
    """Texts that share passages, with copies, repeats, accents and line ends."""
    rng = random.Random(seed)
    vocabulary = ["été", "the", "of", "aa", "b", "Ünder", "x1", "größer", "la"]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(8, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary, k=rng.randint(1, words // 3))))
        rows.append((i * 3 - 20, rng.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, "é" * 400), (503, "é" * 300 + "z"), (504, None), (505, ""), (506, " \n ")]
    return rows


def removed_bytes(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone, mine = bytearray(len(b)), set()
        for k in range(len(b) - window + 1):
            mine.add(b[k : k + window])
            if b[k : k + window] in seen:
                gone[k : k + window] = b"\1" * window
        seen |= mine
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), hashlib.sha256(kept).hexdigest(), len([s for s in bytes(gone).split(b"\0") if s]))
    return out


def removed_words(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g in seen:
                gone[k : k + window] = [True] * window
            seen.add(g)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize(("seed", "window", "hot"), [(1, 50, 0.2), (2, 23, 0.0), (3, 5, 0.0)])
def test_suffix_dedup(spark, seed, window, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_SAMPLE", 64 if hot else 1)  # with a small threshold most anchors are hot
    rows = made_up(seed)
    got = {r["doc_id"]: (r["n_bytes"], hashlib.sha256(bytes(r["kept"])).hexdigest(), len(r["spans"])) for r in suffix_dedup(frame(spark, rows), window, hot=hot).collect()}
    assert got == removed_bytes(rows, window)


def test_suffix_buckets():
    rng = np.random.default_rng(4)
    for depth in (3, 8, 13, 50):
        data = np.frombuffer(bytes(rng.integers(97, 99, 300, dtype=np.uint8)) * 2, np.uint8)
        padded = data.tobytes() + bytes(depth)
        keys = [padded[k : k + depth] for k in range(len(data))]
        pointer = suffix_buckets(data, depth)
        order = np.argsort(pointer, kind="stable")
        assert [keys[k] for k in order] == sorted(keys)
        assert len(set(pointer.tolist())) == len(set(keys))


def test_later_buckets_reuse_refined_pointers():
    """Refined in one part, buckets double what they know each round; parts that come later find pointers that know more."""
    rng = np.random.default_rng(6)
    passage = rng.integers(97, 123, 400, dtype=np.uint8)
    data = np.concatenate([np.concatenate((rng.integers(97, 123, 30, dtype=np.uint8), passage)) for _ in range(20)])
    one, many = [], []
    assert np.array_equal(suffix_buckets(data, 200, 1, one), suffix_buckets(data, 200, 16, many))
    # all at once: 8, 16, ... 256 bytes; in parts: by 8 bytes at the worst, while nothing behind is refined yet
    assert one == [5] and max(many) <= 24 and min(many) < 5


def test_equal_windows_have_equal_anchors():
    """However many texts stand in one chunk."""
    rng = random.Random(3)
    text = bytes(rng.choices(b"abcdef ", k=400))
    alone = suffixes.Minimizers([text], 50)
    among = suffixes.Minimizers([bytes(rng.choices(b"abcdef ", k=3000)) for _ in range(90)] + [text], 50)
    first = among.first[-1]
    assert np.array_equal(alone.anchor[alone.fits], among.anchor[first : first + 351] - first)


def test_pieces_are_told_apart_by_both_hashes():
    """Pieces around one anchor that agree in one hash but not in the other are no copies: both are asked for."""
    rng = np.random.default_rng(8)
    data = rng.integers(97, 123, 300, dtype=np.uint8)
    begin = np.arange(200)
    one, two = common.SliceHashes(data)(begin, begin + 60), common.SliceHashes(data, 1)(begin, begin + 60)
    again = common.SliceHashes(np.concatenate((data[5:], data)), 1)(begin + 295, begin + 355)
    assert len(set(one.tolist()) | set(two.tolist())) == 400 and np.array_equal(two, again)
    anchor, side = 77 << suffixes.SPARE, (3 << 22) | (9 << 12) | 17
    rows = [(anchor | 1, 5, 10), (anchor | 2, 5, 11), (anchor | 1, 5, 12), (anchor + (1 << suffixes.SPARE), 5, 13)]
    h, prints, doc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    out = suffixes._settled(iter([common.long_batch(h=h, print=prints, doc=doc, run=(doc << 32) | side, row=doc)]))
    got = [r for b in out for r in b.to_pylist()]
    assert sorted((r["row"], r["run"], r["ask"]) for r in got if r["ask"] is not None) == [(10, (10 << 16) | 17, 77), (11, (11 << 16) | 17, 77)]
    assert [(r["row"], r["ask"]) for r in got if r["ask"] is None] == [(13, None)]


def test_difference_covers():
    for v, cover in COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize(("seed", "window"), [(1, 20), (2, 5), (3, 2)])
def test_substring_dedup(spark, seed, window):
    rows = made_up(seed)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup(frame(spark, rows), window).collect()}
    assert got == removed_words(rows, window)


def test_substring_small_blocks(spark, monkeypatch):
    """Combining within a task does not depend on how much a task holds."""
    monkeypatch.setattr(common, "CHUNK", 50)
    rows = made_up(5)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup(frame(spark, rows), 6).collect()}
    assert got == {k: v[1] for k, v in removed_words(rows, 6).items()}


def test_dedup_edges(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    rows = [(None, passage), (5, passage + " tail"), (5, "other words"), (7, passage)]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup(frame(spark, rows)).collect())
    # the null id is the least; rows that share an id are documents by themselves
    assert got == [("5", 2, 0), ("5", 31, 30), ("7", 30, 30), ("None", 30, 0)]
    got = sorted((str(r["doc_id"]), r["n_bytes"] - len(r["kept"]) > 0) for r in suffix_dedup(frame(spark, rows)).collect())
    assert got == [("5", False), ("5", True), ("7", True), ("None", False)]
    empty = frame(spark, [(1, "x")]).limit(0)
    assert substring_dedup(empty).count() == 0 and suffix_dedup(empty).count() == 0 and near_duplicates(empty).count() == 0
    kept = substring_dedup(frame(spark, [(1, "a  b\n")]), carry=("spans", "doc"), as_is=True).first()
    assert (kept["kept"], kept["spans"], kept["doc"]) == ("a  b\n", "x", "y")


def shared_ids(seed, n=60):
    """Texts of which many stand under one id, or under none; some rows are the same in both, most passages come again."""
    rng = random.Random(seed)
    passages = [" ".join(f"p{rng.randrange(300)}" for _ in range(rng.randint(15, 40))) for _ in range(12)]
    rows = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.7 else " ".join(f"q{rng.randrange(99)}" for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice([None, 2**63 - 1, -7, *range(8)]) if seed % 2 else rng.choice([None, None, 1, 2, *range(99)]), rng.choice([" ".join(parts), " ".join(parts), None])))
    return rows + rng.sample(rows, 6)


def each_row(rows, window, split, join, within):
    """For each row by itself: what is left, where windows of smaller ids, and with `within` earlier ones of its own, go."""
    rank = lambda i: (i is not None, i or 0)
    units = [split((t or "").encode()) for _, t in rows]
    out = []
    for (i, _), u in zip(rows, units, strict=True):
        seen = {tuple(v[k : k + window]) for (j, _), v in zip(rows, units, strict=True) if rank(j) < rank(i) for k in range(len(v) - window + 1)}
        gone = [False] * len(u)
        for k in range(len(u) - window + 1):
            g = tuple(u[k : k + window])
            if g in seen:
                gone[k : k + window] = [True] * window
            if within:
                seen.add(g)
        out.append(str((i, len(u), sum(gone), join([x for x, g in zip(u, gone, strict=True) if not g]))))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_that_share_an_id(spark, seed, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_SAMPLE", 1 if seed > 1 else 64)
    rows = shared_ids(seed)
    got = sorted(str((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), bytes(r["kept"]))) for r in suffix_dedup(frame(spark, rows), 30, hot=0.0 if seed > 1 else 0.2).collect())
    assert got == each_row(rows, 30, list, bytes, False)
    got = sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept"].encode())) for r in substring_dedup(frame(spark, rows), 8).collect())
    assert got == each_row(rows, 8, bytes.split, b" ".join, True)


def test_row_numbers_are_no_ids(spark):
    rows = [(None, "a"), (None, "b"), (None, "b"), (3, "x"), (3, "y"), (2**63 - 2, "z"), (-5, "z"), (3, None)]
    own = spark.createDataFrame(rows, "doc long, body string").repartition(4).select(common.key_of("doc").alias("doc"), "body")
    got = {(r["doc"], r["body"]): r["row"] for r in common.with_rows(own).collect()}
    assert len(set(got.values())) == len(got) == 7
    assert {b: got[d, b] for d, b in got if d in (2**63 - 2, -5)} == {"z": got[-5, "z"]} and got[-5, "z"] == -5
    new = {v for (d, _), v in got.items() if d in (3, common.NULL_ID)}
    assert len(new) == 5 and max(new) < -5
    with pytest.raises(ValueError):
        common.with_rows(own.unionByName(spark.createDataFrame([(-(2**63) + 1, "q"), (2**63 - 1, "q")], "doc long, body string"))).count()


def components(rows, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent, monkeypatch):
    # so that buckets, regions and stars have several blocks
    monkeypatch.setattr(minhash, "MEMBERS", 4), monkeypatch.setattr(minhash, "TEXTS", 5), monkeypatch.setattr(minhash, "LEAVES", 3)
    rng = random.Random(percent)
    rows = []
    for base in range(6):
        words = [f"w{rng.randint(0, 500)}" for _ in range(150)]
        for k in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 10**6)}"
            rows.append((base * 100 + k, " ".join(copy)))
        # chains, whose ends are no longer alike
        for k in range(12, 20):
            words[rng.randrange(150)] = f"c{k}"
            words[rng.randrange(150)] = f"d{k}"
            rows.append((base * 100 + k, " ".join(words)))
    rows += [(1000, "One two"), (1001, "one TWO"), (1002, "one"), (1003, None), (1004, ""), (1005, "É a"), (1006, "é a"), (1007, rows[0][1].upper())]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(frame(spark, rows), percent).collect()}
    assert got == components(rows, percent)


def test_near_duplicates_of_shared_and_null_ids(spark):
    """Rows that share an id, or have none, are one document, and no row's links are lost."""
    rng = random.Random(5)
    a, b, c, d = (" ".join(f"{x}{rng.randint(0, 500)}" for _ in range(60)) for x in "abcd")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "other words here"), (4, None), (None, c), (None, d), (7, c + " x"), (8, d + " y"), (9, d.upper()), (1, a), (5, None), (6, ""), (4, "")]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(frame(spark, rows)).collect())
    least = common.NULL_ID
    comp = {"1": 1, "2": 1, "3": 1, "4": 4, "None": least, "7": least, "8": least, "9": least, "5": 5, "6": 6}
    size = lambda t: max(len(t.split()) - 4, 1) if (t or "").split() else 0
    assert got == sorted((str(i), size(t), comp[str(i)], str(i) in ("1", "4", "None", "5", "6")) for i, t in rows)


def test_dealt_groups_meet_once(spark, monkeypatch):
    """Any two members of a key that are of different components meet in just one group."""
    rng = random.Random(9)
    rows = [(key, node, comp, 1) for key, n in ((1, 3), (2, 40), (3, 60)) for node, comp in ((k + 100 * key, rng.choice([0, 0, 0, 1, 1, *range(10, 30)])) for k in range(n))]
    df = spark.createDataFrame(rows, "key long, node long, comp long, weight int")
    met = Counter()
    groups = {}
    for r in minhash._dealt(df, 5).collect():
        groups.setdefault((r["key"], r["lo"], r["hi"]), []).append((r["side"], r["node"], r["comp"]))
    for (_, lo, hi), members in groups.items():
        for x in members:
            for y in members:
                if x[1] < y[1] and x[2] != y[2] and (lo == hi or x[0] != y[0]):
                    met[x[1], y[1]] += 1
    assert met == Counter({(x[1], y[1]): 1 for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[2] != y[2]})


def test_connected_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 105), (103, 105), (7, 7)]
    got = {r["doc"]: r["comp"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 103: 100, 105: 100}


def test_signature_recall():
    """Signatures agree about as often as sets are alike."""
    a, b = minhash._coefficients(minhash.ROWS * minhash.BANDS)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**32, 1000, dtype=np.uint64).astype(np.uint32)
    y = np.concatenate((x[:900], rng.integers(0, 2**32, 100, dtype=np.uint64).astype(np.uint32)))
    share = (minhash.minima(x, a, b) == minhash.minima(y, a, b)).mean()
    assert abs(share - 900 / 1100) < 0.08


def test_cover_windows_are_found():
    for window in (2, 4, 9, 20, 50):
        v, cover = substring.cover_for(window)
        m = window - v + 1
        assert m >= 1
        for i in range(v):
            for j in range(v):
                assert any((i + k) % v in cover and (j + k) % v in cover for k in range(window - m + 1))


def test_combine_anchors_marks_all_but_one():
    h, doc = np.array([4, 4, 4, 8, 10, 10], np.uint64), np.array([1, 2, 2, 1, 3, 3])
    rows = sorted(zip(*(c.to_pylist() for c in common.combine_anchors(h, doc, False).columns), strict=True))
    assert Counter(rows) == Counter([(5, 1), (5, 2), (4, 1), (8, 1), (10, 3)])
    rows = sorted(zip(*(c.to_pylist() for c in common.combine_anchors(h, doc, True).columns), strict=True))
    assert Counter(rows) == Counter([(5, 1), (5, 2), (4, 1), (8, 1), (11, 3), (10, 3)])
