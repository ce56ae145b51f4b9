"""Tables with versions."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest

from turnloom.operators import articles as A
from turnloom.operators import manifest as M
from turnloom.sources import snapshots as S

KIND = "file string, hash string, compiled_at timestamp, cost_usd decimal(18,6)"


def runs(spark, *rows):
    return spark.createDataFrame([(f, h, datetime(2024, 1, day), None, e) for f, h, day, e in rows], f"{KIND}, error string")


def held(df):
    return sorted((r["file"], r["hash"]) for r in df.collect())


def test_versions(spark, tmp_path):
    path = str(tmp_path / "m")
    assert held(M.read_manifest(spark, path)) == [] and S.versions(spark, path) == []
    assert M.write_manifest(runs(spark, ("a", "1", 1, None), ("b", "1", 1, "failed")), path) == 1
    assert M.write_manifest(runs(spark, ("a", "0", 1, None), ("c", "1", 2, None)), path) == 2
    assert M.write_manifest(runs(spark, ("a", "2", 3, None)), path) == 3
    assert held(M.read_manifest(spark, path)) == [("a", "2"), ("c", "1")]
    assert held(M.read_manifest(spark, path, 1)) == [("a", "1")] and held(M.read_manifest(spark, path, 2)) == [("a", "1"), ("c", "1")]
    with pytest.raises(ValueError):
        M.read_manifest(spark, path, 4)
    before = M.read_manifest(spark, path)
    assert M.write_manifest(runs(spark, ("z", "9", 9, None)), path) == 4
    assert held(before) == [("a", "2"), ("c", "1")]  # a reader stays with its version
    assert S.expire(spark, path, 2) == 2 and S.versions(spark, path) == [3, 4]
    assert len([p for p in (tmp_path / "m" / "snapshots").iterdir() if p.is_dir()]) == 2
    assert held(M.read_manifest(spark, path, 3)) == [("a", "2"), ("c", "1")]


def test_a_pointer_is_created_once(spark, tmp_path):
    path = f"{tmp_path}/versions/1"
    with ThreadPoolExecutor(16) as pool:
        done = list(pool.map(lambda k: (k, S._create(spark, path, f"text {k}")), range(64)))
    won = [k for k, ok in done if ok]
    assert len(won) == 1 and open(path).read() == f"text {won[0]}"
    assert [p.name for p in (tmp_path / "versions").iterdir() if not p.name.endswith(".crc")] == ["1"]


def test_racing_writers_lose_nothing(spark, tmp_path):
    path, n = str(tmp_path / "m"), 6
    with ThreadPoolExecutor(n) as pool:
        got = list(pool.map(lambda k: M.write_manifest(runs(spark, (f"f{k}", str(k), 1, None)), path), range(n)))
    assert sorted(got) == list(range(1, n + 1))
    assert held(M.read_manifest(spark, path)) == [(f"f{k}", str(k)) for k in range(n)]
    for k in range(1, n + 1):  # every version has one record more
        assert M.read_manifest(spark, path, k).count() == k
    assert len([p for p in (tmp_path / "m" / "snapshots").iterdir() if p.is_dir()]) == n


def test_a_commit_gives_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "_create", lambda *a: False)
    with pytest.raises(S.CommitConflict):
        S.commit(spark, str(tmp_path / "x"), "k int", lambda t: t, attempts=2)
    assert not [p for p in (tmp_path / "x" / "snapshots").iterdir() if p.is_dir()]


def test_index(spark, tmp_path):
    row = lambda k, s: spark.sql(f"select '{k}' key, '{s}' summary, 'l' sources, date'2024-01-01' updated, 1 more")
    A.write_index(row("a", "old").unionByName(row("b", "b")), str(tmp_path))
    A.write_index(row("a", "new"), str(tmp_path))
    assert {r["key"]: r["summary"] for r in S.read_snapshot(spark, str(tmp_path), A.INDEX_SCHEMA).collect()} == {"a": "new", "b": "b"}
