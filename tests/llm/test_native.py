"""Decontamination, mixing and URL rules against brute force, and their plans."""

import random
import re
from collections import Counter, defaultdict

import pytest

from turnloom.llm import decontaminate as dc
from turnloom.llm.decontaminate import contamination, decontaminate
from turnloom.llm.mixing import emit, mix
from turnloom.llm import urls
from turnloom.llm.urls import PATTERNS, SITES, judge_urls, pattern, rule_table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return WORD.findall(t)


def brute(docs, bench, n=13):
    wins = {}
    for item, t in bench:
        w = words(t)
        size = min(len(w), n)
        for k in range(len(w) - size + 1) if w else ():
            wins.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    out = {}
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for k in range(len(w)):
            for size in {len(x) for x in wins}:
                g = tuple(w[k : k + size])
                if len(g) == size and g in wins:
                    hit |= set(range(k, k + size))
                    items |= wins[g]
        out[i] = (len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("few", [True, False])
def test_contamination(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(dc, "FEW_BYTES", 0)
    rng = random.Random(7)
    vocabulary = ["É", "é", "A", "b-c", "d'e", "x1", "ß"]
    bench = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for k in range(10)] + [(50, "Only three words"), (51, None), (52, "...")]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)) + (bench[k % 10][1] or "").upper().split())) for k in range(30)]
    docs += [(100, None), (101, ""), (102, "say ONLY three, words"), (103, "É " * 15), (104, bench[3][1].swapcase())]
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, h int, spans string")
    b = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, size int")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in contamination(d, b).collect()}
    assert got == brute(docs, bench)
    bad = {i for i, x in got.items() if x[3]}
    assert {r["doc_id"] for r in decontaminate(d, b).collect()} == {i for i, _ in docs} - bad
    spans = {r["doc_id"]: r["text"] for r in decontaminate(d, b, "spans").collect()}
    assert spans[102] == "say" and spans[101] == "" and set(spans) == {i for i, _ in docs}


def test_contamination_edges(spark):
    d = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in contamination(d, none).collect()] == [0, 0, 0]
    assert contamination(d.limit(0), none).count() == 0
    b = spark.createDataFrame([(None, "a b c")], "item_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_words"], r["items"]) for r in contamination(d, b).collect()) == [("1", 1, []), ("1", 3, [""]), ("None", 3, [""])]


@pytest.mark.parametrize("few", [True, False])
def test_contamination_of_rows_that_share_an_id(spark, few, monkeypatch):
    """Each row is judged by its own words, and exactly the contaminated rows go."""
    if not few:
        monkeypatch.setattr(dc, "FEW_BYTES", 0)
    rng = random.Random(11)
    bench = [(k, " ".join(f"b{rng.randrange(50)}" for _ in range(rng.randint(3, 25)))) for k in range(6)]
    texts = [None, "", *[" ".join([*(f"x{rng.randrange(9)}" for _ in range(rng.randrange(30))), *rng.choice(bench)[1].split()[: rng.randrange(26)]]) for _ in range(12)]]
    docs = [(rng.choice([None, 1, 2, 3]), rng.choice(texts)) for _ in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")
    want = [(i, t, *brute([(i, t)], bench)[i]) for i, t in docs]
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in contamination(d, b).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *x)) for i, _, *x in want) and 5 < sum(x[-1] for x in want) < 55
    assert sorted(str(tuple(r)) for r in decontaminate(d, b).collect()) == sorted(str((i, t)) for i, t, *_, bad in want if not bad)


def test_decontamination_of_clashing_columns_and_long_texts(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    long = " ".join(f"x{k % 977}" for k in range(250_000))
    docs = [(1, passage), (2, long), (3, long + " " + passage), (4, None), (5, "")]
    names = ("doc", "spans", "__doc", "__spans", "body", "extra", "w", "h")
    d = spark.createDataFrame([(i, t, *"abcdefgh") for i, t in docs], "doc_id long, text string, " + ", ".join(f"`{x}` string" for x in names))
    b = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["contaminated"]) for r in contamination(d, b).collect()}
    assert got == {1: (40, 40, True), 2: (250_000, 0, False), 3: (250_040, 40, False), 4: (0, 0, False), 5: (0, 0, False)}
    kept = decontaminate(d, b)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 4, 5}
    spans = {r["doc_id"]: r for r in decontaminate(d, b, "spans").collect()}
    assert spans[3]["text"] == long and spans[1]["text"] == "" and spans[1]["__spans"] == "d" and spans[1]["h"] == "h"


def level(sizes, weights=(3, 1, 2), percent=150, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = percent * sum(sizes.values()) / 100, set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and most * sizes[s] <= weight[s] * rest / free} if free else set()
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * rest / free for s in sizes}
        full |= over


def test_mix(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(["w"] * rng.randint(0, 50)), rng.choice(["a", "b", "B", "é", None, "c"] + ["hot"] * 6)) for k in range(600)] + [(601, None, "empty"), (602, "", "empty")]
    d = spark.createDataFrame([(*x, 1, 2.0) for x in docs], "doc_id long, text string, source string, rate int, target double").repartition(3)
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len((t or "").split())
    want, rows = level(sizes), mix(d).collect()
    source = {i: s for i, _, s in docs}
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6
        assert 0 <= r["copies"] <= 2
        taken[source[r["doc_id"]]] += r["size"] * r["copies"]
    assert len(rows) == len(docs)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.2 * t + 200
    assert sorted(map(tuple, mix(d).collect())) == sorted(map(tuple, rows))
    copies = emit(d).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in copies} == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}


def test_mix_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mix(spark.createDataFrame([], schema)).count() == 0 and emit(spark.createDataFrame([], schema)).count() == 0
    only = mix(spark.createDataFrame([(1, None, None), (None, "", None)], schema)).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in only] == [(0, 0.0, 0)] * 2


def test_mix_of_shared_and_null_ids(spark):
    """Rows that share an id, or have none, draw for themselves, so that sources still come near their targets."""
    rows = [(None if k % 2 else 7, "w " * 10, "abc"[k % 3]) for k in range(900)]
    d = spark.createDataFrame([(*x, 9, "c") for x in rows], "doc_id long, text string, source string, copy int, `__rate` string").repartition(5)
    out = mix(d).collect()
    taken = Counter()
    for r in out:
        assert 0 <= r["copies"] <= 2
    for r in emit(d).collect():
        taken[r["source"]] += 10
        assert r["__rate"] == "c" and r["copy"] in (1, 2)
    want = level({"a": 3000, "b": 3000, "c": 3000})
    assert all(abs(taken[s] - want[s]) <= 0.15 * want[s] for s in want) and sum(taken.values()) == sum(r["size"] * r["copies"] for r in out)
    assert Counter(map(tuple, mix(d.repartition(2)).collect())) == Counter(map(tuple, out))


URLS = {
    "http://www.example.com/en/1": ("www.example.com/en/", "allow"), "https://EXAMPLE.com/en/": ("example.com/en/", "block"), "http://a.example.com/en/x?y": ("example.com/en/", "block"),
    "http://notexample.com/en/": ("com/", "allow"), "http://example.com": (None, "allow"), "http://com/": ("com/", "allow"), "http://x.net/es/1": ("net/es/", "block"), "http://x.net/ES/1": (None, "allow"),
    "http://net/fr/": ("net/fr/", "block"), "http://a.org/en": (None, "allow"), "no scheme com/": (None, "allow"), None: (None, "allow"), "": (None, "allow"), "http://spam-farm.example.org/x": (None, "block"),
    "http://a.com:80/": (None, "allow"), "http://a.com?x=/": (None, "allow"), "http://casino.org/": (None, "block"), "ftp://u://x.com/": (None, "allow"), "http://a\nb.com/": ("com/", "allow"),
}


def test_urls(spark):
    rows = [(k, u, "h", "v") for k, u in enumerate(URLS)] * 2 + [(None, "http://a.com/", "h", "v")]
    out = judge_urls(spark.createDataFrame(rows, "page_id long, url string, rule string, host string")).collect()
    assert len(out) == len(rows)
    listed = list(URLS)
    for r in out:
        want = ("com/", "allow") if r["page_id"] is None else URLS[listed[r["page_id"]]]
        assert (r["rule"], r["verdict"]) == want, r
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rules_are_found_by_the_rarest_token(spark):
    """A rule whose tokens no url has is never tried; others fit as their regular expressions do."""
    listed = [f"http://h{k}.org/{'rare' if k == 3 else 'usual'}/common" for k in range(8)]
    mine = rule_table(spark, (*SITES, *PATTERNS, pattern("block", r"/rare/common", "rare", "common")))
    out = judge_urls(spark.createDataFrame(list(enumerate(listed)), "page_id long, url string"), mine).collect()
    assert {r["page_id"] for r in out if r["verdict"] == "block"} == {3}


def test_rules_without_a_token_are_tried_everywhere(spark):
    listed = ["http:///", "http://a.org/", "", "http://-/x", None, "http://éé/"]
    mine = rule_table(spark, (*SITES, *PATTERNS, pattern("block", r"^https?://[^a-z]*/$")))
    nulls = mine.unionByName(spark.sql("select 'block' verdict, 'n' name, '^$' pattern, cast(null as array<string>) tokens, 'pattern' kind"))
    for table, want in ((mine, {0, 5}), (nulls, {0, 2, 5}), (rule_table(spark), set())):
        out = judge_urls(spark.createDataFrame(list(enumerate(listed)) * 2, "page_id long, url string"), table).collect()
        assert len(out) == 12 and {r["page_id"] for r in out if r["verdict"] == "block"} == want


@pytest.mark.parametrize("few", [True, False])
def test_thousands_of_rules(spark, few, monkeypatch):
    """As many as if each rule were tried on each url."""
    if not few:
        monkeypatch.setattr(urls, "FEW_BYTES", 0)
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randint(0, 30))
    host = lambda: ".".join([word() for _ in range(rng.randint(0, 2))] + [rng.choice(["com", "net", "org"])])
    rules = [urls.site(rng.choice(["allow", "block"]), f"{host()}/{word() + '/' if rng.random() < 0.5 else ''}") for _ in range(1500)]
    rules = list({r.name: r for r in rules}.values())
    for _ in range(1500):
        w, v = word(), word()
        rules.append(pattern(rng.choice(["block", "block", "allow"]), rf"[./]{w}[./].*{v}", w, v))
    pages = [(k, f"http://{host()}/{'/'.join(word() for _ in range(rng.randint(0, 4)))}{rng.choice(['', '/', '?q=' + word()])}") for k in range(400)] * 2
    table = spark.createDataFrame([(r.verdict, r.name, r.pattern, list(r.tokens), r.kind) for r in rules], "verdict string, name string, pattern string, tokens array<string>, kind string")
    got = Counter((r["page_id"], r["rule"], r["verdict"]) for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string"), table).collect())
    want, tried = Counter(), [re.compile(r.pattern) for r in rules if r.kind == "pattern" and r.verdict == "block"]
    for k, u in pages[: len(pages) // 2]:
        h, _, p = u.split("://", 1)[1].split("?")[0].partition("/")
        fits = [r for r in rules if r.kind == "site" and (h == r.name.partition("/")[0] or h.endswith("." + r.name.partition("/")[0])) and ("/" + p).startswith("/" + r.name.partition("/")[2]) and "/" in u.split("://", 1)[1]]
        best = max(fits, key=lambda r: (len(r.name), r.name), default=None)
        blocked = any(x.search(u) for x in tried)
        want[k, best.name if best else None, best.verdict if best else "block" if blocked else "allow"] += 2
    assert got == want and len({v for _, _, v in got}) == 2


@pytest.mark.parametrize("name", ["op3_decontamination", "op5_url_filter", "op8_source_mixing"])
def test_native_plans(spark, sf_dir, name):
    from turnloom.llm.queries import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)
