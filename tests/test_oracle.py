"""Every registered query against its DuckDB oracle on the smallest driver tables
(the same comparison the correctness gate runs at sf0.01), plus the entry smoke."""

import math
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, norm  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["u", "t", "k7", "n7", "n7_lag7", "ratio7_lag7", "ratio7_same"]
    assert df.count() > 0


def test_every_query_has_a_callable_and_names_match():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 50


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF)
    cols = sdf.columns
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(cols) == sorted(rel.columns)
    order = sorted(cols)
    a = sorted(tuple(norm(r[c]) for c in order) for r in sdf.collect())
    dcols = rel.columns
    b = sorted(tuple(norm(r[dcols.index(c)]) for c in order) for r in rel.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            if p != q:
                assert p[0] == 1 and q[0] == 1 and math.isclose(float(p[1]), float(q[1]), rel_tol=1e-12), (name, x, y)
