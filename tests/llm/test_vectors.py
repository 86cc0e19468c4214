"""k-means tree search and hard negatives against brute force."""

import duckdb
import numpy as np
import pytest

from panelfx.llm import kmtree, negatives, oracle, queries

SMALL = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int, row int, vec string, id string, score double"


def frame(spark, rows):
    """Vectors with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, y, 1, "v", "i", 0.5) for i, v, y in rows], KIND).repartition(3)


def clustered(n, dim, seed, hot=0.3):
    """A third of the rows around (some of them exactly on) one point, the others loose."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    near = rng.random(n) < hot
    x[near] = rng.normal(size=dim) + rng.normal(size=(near.sum(), dim)) * rng.choice([0, 0, 1e-3], size=(near.sum(), 1))
    return x.astype(np.float32)


def plain_nearest(ids, x, every, k):
    x, out = x.astype(np.float64), {}
    for i, q in zip(ids, x):
        if i % every == 0:
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            out[i] = sorted((s, j) for s, j in zip(d.tolist(), ids) if j != i)[:k]
    return out


def recall(got, want):
    """Share of the true neighbours found, by their distances."""
    hit = sum(sum(1 for s, _ in w if s <= got[q][-1][0] and s in [g[0] for g in got[q]]) for q, w in want.items())
    return hit / sum(map(len, want.values()))


@pytest.mark.parametrize("n,dim,seed", [(3000, 16, 0), (2500, 40, 1)])
def test_tree_search_recall_and_scores(spark, n, dim, seed):
    x, ids = clustered(n, dim, seed), list(range(n))
    rows = kmtree.search(frame(spark, zip(ids, x.tolist(), [0] * n)), every=25).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = plain_nearest(ids, x, 25, 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert all(v == sorted(v) for v in got.values())
    wide = x.astype(np.float64)
    assert all(s == np.sqrt(((wide[q] - wide[j]) ** 2).sum()) and j != q for q, v in got.items() for s, j in v)
    assert recall(got, want) >= 0.9


def test_ties_go_to_the_smaller_id(spark):
    """Every leaf is visited where recall asks for all: the result is exact then."""
    x = np.repeat(np.eye(4, dtype=np.float32), 200, axis=0)
    ids = np.random.default_rng(0).permutation(800).tolist()
    got = kmtree.search(frame(spark, zip(ids, x.tolist(), [0] * 800)), recall=1.0).collect()
    want = plain_nearest(ids, x, 100, 10)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == \
        sorted((q, i + 1, j, s) for q, v in want.items() for i, (s, j) in enumerate(v))


ODD = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [1.0, 2.5], 1), (None, [1.0, 2.0], 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 2),
       (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [None, 1.0], 1), (8, [1.0, 2.0, 3.0], 1), (9, [1.0, 1.0], None),
       (10, [1.0, 1.5], 2), (11, [3.0, 4.0], 2), (100, None, 2), (200, [0.0, 0.0], 2), (300, [1e38, 1e38], 1), (400, [-1.0, 1.0], 3)]


def test_tree_search_of_odd_rows(spark):
    rows = kmtree.search(frame(spark, ODD)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    # three rows share id 0, each a query of its own; null, zero, broken and longer vectors take no part
    assert set(by) == {0, 300, 400} and len(by[0]) == 24 and len(by[300]) == 8
    first = sorted(by[0], key=lambda x: (x[0], x[2]))[:3]
    assert [x[1:] for x in first] == [(0, 0.0), (0, 0.0), (0, 0.5)]
    assert (2, None, 0.0) in by[0] and {j for _, j, _ in by[400]} == {0, None, 9, 10, 11, 300}
    assert kmtree.search(frame(spark, [])).collect() == []
    assert kmtree.search(frame(spark, [(0, [1.0], 1)])).collect() == []


def test_strassen_is_exact():
    rng = np.random.default_rng(0)
    for m, d, n in [(1, 1, 1), (3, 5, 7), (65, 33, 70), (0, 4, 3), (4, 0, 3), (37, 64, 129)]:
        a, b = rng.integers(-2**28, 2**28, (m, d)), rng.integers(-2**28, 2**28, (d, n))
        assert (negatives.strassen(a, b, cut=2) == a @ b).all() and (negatives.strassen(a, b) == a @ b).all()


def plain_negatives(rows, every):
    rows = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v], y) for i, v, y in rows]
    out = []
    for n, (i, v, y) in enumerate(rows):
        if i is None or i % every:
            continue
        key = lambda s: (-s[0], s[1] is None, s[1] or 0)
        score = [(sum(p * q for p, q in zip(v, w)), j, z) for m, (j, w, z) in enumerate(rows) if m != n]
        for s, j, _ in sorted((x for x in score if x[2] == y), key=key)[:5]:
            inside = sorted((x for x in score if x[2] != y and 80 * s <= 100 * x[0] <= 100 * s), key=key)[:5]
            out += [(i, j, k + 1, x[1], s, x[0]) for k, x in enumerate(inside)]
    return sorted(out, key=str)


def test_hard_negatives_against_plain(spark):
    rng = np.random.default_rng(2)
    x = clustered(700, 9, 3)
    rows = [(int(i), v, int(y)) for i, v, y in zip(rng.permutation(700), x.tolist(), rng.choice(5, 700, p=[.5, .2, .1, .1, .1]))]
    tile, block = negatives.TILE, negatives.BLOCK
    try:
        negatives.TILE, negatives.BLOCK = 90, 11        # many tiles and blocks, a label over several
        got = negatives.hard_negatives(frame(spark, rows), every=20).collect()
    finally:
        negatives.TILE, negatives.BLOCK = tile, block
    assert sorted((tuple(r) for r in got), key=str) == plain_negatives(rows, 20)


def test_hard_negatives_of_odd_rows(spark):
    got = sorted((tuple(r) for r in negatives.hard_negatives(frame(spark, ODD)).collect()), key=str)
    part = [r for r in ODD if r[2] is not None and r[1] and len(r[1]) == 2 and r[0] not in (4, 5, 6, 300)]
    assert got == plain_negatives(part, 100)
    assert negatives.hard_negatives(frame(spark, [])).collect() == []
    assert negatives.hard_negatives(frame(spark, [(0, [1.0], 1), (1, [2.0], 1)])).collect() == []


def test_registered_search_on_the_tables(spark):
    con = duckdb.connect()
    ids, x = zip(*con.sql(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet' ORDER BY 1").fetchall())
    got = {}
    for r in sorted(queries.QUERIES["op11_kmeans_tree"](spark, SMALL).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = plain_nearest(ids, np.array(x, np.float32), 100, 10)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    assert "op11_kmeans_tree" not in oracle.SQL
