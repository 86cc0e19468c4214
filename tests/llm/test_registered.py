"""The registered text queries against their SQL, and the pipeline against its stages."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from panelfx.llm import common, oracle, queries

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(oracle.SQL) <= set(queries.QUERIES) and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    rel = con.sql(oracle.SQL[name])
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(rel.columns)
    cols = sorted(rel.columns)
    want = sorted(tuple(map(str, r)) for r in rel.project(", ".join(cols)).fetchall())
    assert sorted(tuple(map(str, r)) for r in got.select(cols).collect()) == want


def test_pipeline_stages(spark):
    docs = common.read(spark, SMALL, "documents")
    seen, cur = set(r.doc_id for r in docs.collect()), docs
    for name, fn in corpus_pipeline.STAGES[:-1]:
        out = common.stage(fn(spark, cur, SMALL), "t")
        assert out.columns == docs.columns
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen
        seen, cur = set(ids), out
    last = corpus_pipeline.STAGES[-1][1](spark, cur, SMALL).collect()
    assert {r.doc_id for r in last} == seen and all(r.round_trip for r in last)
    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.ids) for r in whole) == sorted((r.doc_id, r.ids) for r in last)


def test_pipeline_takes_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        cur = docs
        for _, fn in corpus_pipeline.STAGES[:-1]:
            cur = common.stage(fn(spark, cur, SMALL), "t")
            assert cur.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, cur, SMALL).collect()
