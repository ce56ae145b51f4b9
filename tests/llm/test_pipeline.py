"""The pipeline, stage by stage, against plain-Python statements on the smallest tables."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from test_dedup import components, removed_words
from test_native import brute, level


@pytest.fixture(scope="module")
def outs(spark, sf_dir, tmp_path_factory):
    docs, frames = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    frames["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = frames[name] = spark.read.parquet(path)
    return {k: [tuple(r[c] for c in corpus_pipeline.COLUMNS) + ((r["copy"],) if "copy" in df.columns else ()) for r in df.collect()] for k, df in frames.items()}


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_language_stage(outs):
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert sorted(outs["language_id"]) == sorted(r for r in outs["documents"] if letters(r[1]))


def test_language_stage_with_null_languages(spark, sf_dir):
    rows = [(k, t, lang, "s", len(t)) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)]
    rows += [(10, "der hund und die katze", None, "s", 22), (11, "123 !?", None, "s", 6), (12, None, "en", "s", 0), (13, "the cat and the dog", "de", "s", 19)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, kind)
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, docs, sf_dir).collect()}
    assert got == {r[0]: r[2] for r in rows[:10]} | {10: "de", 13: "de"}
    none = spark.createDataFrame([r[:2] + (None,) + r[3:] for r in rows], kind)
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, none, sf_dir).collect()}
    assert got == dict.fromkeys([*range(11), 13])


def test_near_dedup_stage(outs):
    keep = {i for i, x in components(pairs(outs["language_id"]), 80).items() if x[2]}
    assert sorted(outs["near_dedup"]) == sorted(r for r in outs["language_id"] if r[0] in keep)


def test_passage_stage(outs):
    want = removed_words(pairs(outs["near_dedup"]), 20)
    rows = {r[0]: r for r in outs["near_dedup"]}
    expect = [(i, rows[i][1] if m == 0 else kept, rows[i][2], rows[i][3], rows[i][4] if m == 0 else len(kept)) for i, (n, m, kept) in want.items() if m == 0 or m < n]
    assert sorted(outs["passage_dedup"]) == sorted(expect)


def test_decontamination_stage(spark, sf_dir, outs):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute(pairs(outs["passage_dedup"]), bench)
    assert sorted(outs["benchmark_decontamination"]) == sorted(r for r in outs["passage_dedup"] if not want[r[0]][3])


def test_mixing_stage(outs):
    sizes = Counter()
    for r in outs["benchmark_decontamination"]:
        sizes[r[3]] += len((r[1] or "").encode().split())
    want, copies, words = level(dict(sizes)), Counter(r[0] for r in outs["source_mixing"]), Counter()
    for r in outs["benchmark_decontamination"]:
        rate = want[r[3]] / sizes[r[3]]
        assert int(rate) <= copies[r[0]] <= int(rate) + 1
        words[r[3]] += copies[r[0]] * len((r[1] or "").encode().split())
    assert sorted(set(r[:5] for r in outs["source_mixing"])) == sorted(r for r in outs["benchmark_decontamination"] if copies[r[0]])
    assert abs(sum(words.values()) - sum(want.values())) < 0.2 * sum(want.values())


def test_run_agrees_with_stages(spark, sf_dir, outs):
    got = [tuple(r[c] for c in [*corpus_pipeline.COLUMNS, "copy"]) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert sorted(got) == sorted(outs["source_mixing"])
