"""The numbered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from turnloom.llm.queries import QUERIES
from turnloom.llm.sql import ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: sorted(tuple("null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))
    assert plain(got) == plain(want)


def test_digests_of_the_other_queries(spark, sf_dir):
    import hashlib

    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op2_media_columns"](spark, sf_dir).collect():
        padded = docs[r["doc_id"]] + b"\xff" * (r["payload_bytes"] - r["n_bytes"])
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and len(r["feature"]) == 16
        assert r["tail_crc32"] == __import__("zlib").crc32(padded[-32:])
