"""Filter audit, toxicity and hard negatives against brute force."""

import random
from fractions import Fraction
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pytest

from turnloom.llm import audit, negatives, toxicity

CLASH = "doc part sum first good toxic mask held A E body extra score terms key id anchor block rkey best".split()
EXTRA = ", ".join(f"`{c}` string" for c in CLASH)


# ---- filter audit -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_least_squares_gives_shapley_values(k):
    rng = random.Random(k)
    value = [0] + [rng.randrange(100) for _ in range((1 << k) - 1)]
    want = [Fraction(0)] * k
    for p in permutations(range(k)):
        before = 0
        for i in p:
            want[i] += Fraction(value[before | 1 << i] - value[before], factorial(k))
            before |= 1 << i
    assert audit.shapley(value, audit.kernel_equations(k)) == want


def plain_audit(docs, labels):
    """docs: (id, text, source); labels: (id, quality, toxic). Step by step, with the documents themselves."""
    key = lambda i: -(2**63) if i is None else i
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = t.encode().split()
        fails = ""
        fails += "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum(x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for x in t) > 2 * len(t))
        fails += "D" * any(x in t for x in "#$%&*|") + "E" * any((u or "") == t and key(j) < key(i) for j, u, _ in docs)
        rows.append((s or "", fails, any(j == i and q == 1 for j, q, _ in labels if i is not None), any(j == i and x == 1 for j, _, x in labels if i is not None)))
    out = set()
    for part in {r[0] for r in rows}:
        mine, found = [r for r in rows if r[0] == part], []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in mine) - len(gone)
                left = [r for r in left if f not in r[1]]
                found.append((part, "".join(order), step, len(left), len(gone), redundant, sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        total = {f: sum(r[4] for r in found if r[1][r[2] - 1] == f) for f in "ABCDE"}
        out |= {(*r, total[r[1][r[2] - 1]]) for r in found}
    return out


def test_audit(spark):
    rng = random.Random(5)
    texts = [None, "", "ABC", "a # b", " ".join(map(str, range(250))), "x " * 300, "ÄÖ   É " * 80, "Aa " + "b c d " * 100, " x\x0b y", " ".join(f"w{k}|" for k in range(60_000))]
    docs = [(rng.choice([None, *range(12)]), rng.choice(texts), rng.choice([None, "", "s", "t"])) for _ in range(90)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [None, *range(8), 3, 3]]
    frame = spark.createDataFrame([(*d, *CLASH) for d in docs], f"doc_id long, text string, source string, {EXTRA}").repartition(3)
    known = spark.createDataFrame([(*x, "z", "z") for x in labels], "doc_id long, quality int, toxic int, good string, doc string")
    out = audit.audit_texts(frame, known)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(docs, labels)
    assert audit.audit_texts(frame.limit(0), known).count() == 0 and audit.audit_texts(frame, known.limit(0)).agg({"good_lost": "max"}).first()[0] == 0


def test_audit_of_other_filters(spark):
    rows = spark.createDataFrame([("p", True, None, True, None), ("p", True, True, False, True), (None, False, False, True, True)], "part string, `x.y` boolean, b boolean, good boolean, toxic boolean")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.audit(rows, ["x.y", "b"]).collect()}
    assert len(got) == 8 and got["p", "bx.y", 1] == (1, 1, 0, 0, 0, 1, 1) and got["p", "bx.y", 2] == (0, 1, 1, 1, 1, 0, 3) and got["", "bx.y", 2] == (1, 0, 0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        audit.audit(rows, ["b", "b"])


# ---- toxicity ---------------------------------------------------------------------------------------------


def test_folding_undoes_disguises():
    plain = toxicity.fold("clown idiot")
    for t in ("CLOWN idiot", "c1own 1d10t", "сlоwn іdіоt", "ｃｌｏｗｎ  𝐢𝐝𝐢𝐨𝐭", "clo​wn id­iot", "c|own, !d!ot", "_clown--idiot_"):
        assert toxicity.fold(t) == plain, t
    assert toxicity.fold("") == toxicity.fold(" .. ") .strip() + " " == " "
    assert toxicity.fold("the$$$ 2024 b2") == " the 2024 b2 "  # signs and digits stay where no letter follows


def spelled(text, lexicon):
    """Terms that count in folded text, by looking at every place for every term."""
    covered = [(k, k + len(e)) for e in lexicon.exceptions for k in range(len(text)) if text.startswith(e, k)]
    found = [(k, t, w) for t, w in lexicon.terms.items() for k in range(len(text)) if text.startswith(t, k)]
    return sorted(x for x in found if not any(s <= x[0] and x[0] + len(x[1].rstrip()) <= e for s, e in covered))


def test_matching_is_that_of_a_plain_search():
    rng = random.Random(3)
    lexicon = toxicity.Lexicon({" ab": 1.0, " abc": 2.0, " ba ": 0.5, " cc": 3.0}, [" ab ", " ba ba ", " abcc ab ", " cc"])
    found = lexicon.automaton()
    for _ in range(300):
        text = toxicity.fold(" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(12))))
        assert toxicity.hits(found, text) == spelled(text, lexicon)


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "ri", "mo", "ten", "su", "la"]) for _ in range(rng.randrange(1, 4)))
    out = []
    for i in range(n):
        words, bad = [word() for _ in range(rng.randrange(5, 150))], i % 5 == 0
        for _ in range(max(2, len(words) // 40) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "zorf" + word()]))
        if not bad and i % 40 == 1:
            words[0:0] = ["zorflora"]
        out.append((i, " ".join(words), int(bad)))
    return out


def test_terms_and_exceptions_are_learned(spark):
    rows = corpus(600, 1)
    lexicon = toxicity.fit_lexicon([t for _, t, _ in rows], [y for *_, y in rows], ["grobnik bun"])
    assert {" grobnik", " zorf"} <= set(lexicon.terms) and {" zorfiora ", " grobnik bun "} <= set(lexicon.exceptions)
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    tests = corpus(200, 2) + [(1000, "kari GR0BNIK mo zorfla 1n", 1), (1001, "kari grobnik bun mo zorflora in", 0), (1002, None, 0), (1002, "", 0), (None, "kari", 0)]
    out = toxicity.score_toxicity(spark.createDataFrame([(i, t, *CLASH) for i, t, _ in tests], f"doc_id long, text string, {EXTRA}").repartition(3), train, exceptions=["grobnik bun"])
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert len(got) == len(tests) and all(0 <= r["score"] <= 1 and r["extra"] == "extra" for r in got.values())
    right = [(got[i, t]["score"] >= 0.3) == bool(y) for i, t, y in tests]
    assert np.mean(right) > 0.98 and all(right[200:])
    assert got[1002, None]["score"] == got[1002, ""]["score"] and got[1001, tests[201][1]]["terms"] == []


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for train in (docs.selectExpr("*", "null as toxic"), docs.selectExpr("*", "1 as toxic"), docs.selectExpr("*", "0 as toxic")):
        assert toxicity.score_toxicity(docs, train).where("score between 0 and 1 and size(terms) = 0").count() == 2
    assert toxicity.score_toxicity(docs.limit(0), docs.selectExpr("*", "1 as toxic")).count() == 0


# ---- hard negatives ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [0, 1, 200, 2**27])
def test_lookups_give_inner_products(most):
    rng = np.random.default_rng(most)
    a, c = rng.integers(-most, most + 1, (7, 24)), rng.integers(-most, most + 1, (50, 24))
    assert (negatives.scores(negatives.subset_sums(a), negatives.bit_planes(c)) == c @ a.T).all()


def plain_negatives(rows, n_pos, n_neg):
    """rows: (id, label, vector, anchor)."""
    from itertools import zip_longest

    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    rank = lambda i: (-s(i), rows[i][0] is None, rows[i][0] or 0)
    out = []
    for k, (aid, label, v, anchor) in enumerate(rows):
        if not anchor:
            continue
        s = lambda i, v=v: sum(x * y for x, y in zip_longest(v, rows[i][2], fillvalue=0))
        positives = sorted((i for i in range(len(rows)) if i != k and rows[i][1] == label), key=rank)[:n_pos]
        for p in positives:
            fits = sorted((i for i in range(len(rows)) if rows[i][1] != label and 80 * s(p) <= 100 * s(i) <= 100 * s(p)), key=rank)[:n_neg]
            out += [(aid, rows[p][0], r, rows[i][0], s(p), s(i)) for r, i in enumerate(fits, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("seed", range(2))
def test_hard_negatives(spark, seed, monkeypatch):
    monkeypatch.setattr(negatives, "FEW_ROWS", 20)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rng = random.Random(seed)
    some = [[rng.randrange(-3, 4) for _ in range(11)] for _ in range(9)]
    rows = []
    for _ in range(120):
        vector = rng.choice(some) if rng.random() < 0.5 else [rng.randrange(-300, 300) for _ in range(rng.choice([0, 3, 11, 11, 11]))]
        rows.append((rng.choice([None, *range(60)]), rng.choice([None, 1, 2, 2, 3]), rng.choice([vector, vector, vector, None, [1, None]]), rng.choice([True, False, None])))
    frame = spark.createDataFrame(rows, "id long, label long, vector array<long>, anchor boolean").repartition(3)
    out = negatives.hard_negatives(frame, 3, 2).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(str(tuple(r)) for r in out.collect()) == plain_negatives(rows, 3, 2)


def test_quantized_and_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, 1, [0.5, -0.001]), (None, 2, []), (2, None, [1.0]), (3, 1, None), (4, 1, [None, 1.0]), (5, 1, [inf]), (6, 1, [-inf]), (7, 1, [nan])]
    frame = spark.createDataFrame([(*r, *CLASH) for r in rows], f"vec_id long, label int, embedding array<float>, {EXTRA.replace('`id` string', '`id2` string')}")
    got = sorted(map(str, (tuple(r) for r in negatives.quantized(frame).collect())))
    assert got == sorted(["(1, 1, [128, -1])", "(None, 2, [])"])
    none = negatives.quantized(frame).selectExpr("*", "true as anchor")
    assert negatives.hard_negatives(none).count() == 0 and negatives.hard_negatives(none.limit(0)).count() == 0
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([(1, 1, [2**31] * 8, True)], "id long, label long, vector array<long>, anchor boolean"))
