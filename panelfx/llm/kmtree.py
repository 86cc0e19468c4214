"""Approximate nearest neighbours: a hierarchical k-means tree walked best bin first.

Index. The tree is fitted on a bounded sample of the rows (`SAMPLE` rows, of wide vectors
fewer: `SAMPLE_BYTES`): every node over `leaf` sample rows is split by k-means into up to
`BRANCH` children. Every row of the table then goes down to the nearest child's leaf; the
rows of each leaf are counted and their largest distance from its centre kept.

Search. A query walks the tree best bin first: down to the nearest leaf, every branch not
taken into a priority queue by its centre's distance, on from the queue's nearest branch,
until it has visited the calibrated number of leaves (and leaves of more than k rows).

Calibration. For `CALIBRATION` sample rows the exact neighbours among all rows are found by
one pass over the table. The number of leaves visited is widened until the share of those
neighbours that lie in visited leaves reaches `RECALL`.

Distribution. The subtree below a child of the root is a cell; a cell's rows are dealt to
tiles of at most about `TILE` rows and the queries to blocks of about `BLOCK`, and each
(tile, block) is one group of its own: a leaf with a third of all rows is many tiles.
Inside a group the distances are matrix products per leaf; the near ones are computed again
from the differences, so scores are exact. A group returns at most k rows for a query. The
first eighth of the leaves is visited first: its k-th distance bounds what later leaves return,
and leaves that lie wholly beyond it are not visited.

Defined results. Queries whose vector takes no part have no rows. Null, zero and non-finite
vectors take no part, nor do lengths other than the most frequent (see `vectors`). Ties go to
the smaller id, a null id last; rows that share an id or repeat in full are rows of their own,
each but the query itself a candidate. Fewer candidates than k: all. Empty table: no rows.
Distances beyond the double range are infinite. Other columns, whatever their names, are not
read. There is no text; very long vectors shorten the sample and the tree, nothing else.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .vectors import matrix, order_of_ids, spread, usable

SAMPLE = 32_768
SAMPLE_BYTES = 64 << 20
BRANCH = 16
CALIBRATION = 256
RECALL = 0.95
TILE = 8_192
BLOCK = 4_096
GRID = 1 << 20      # entries of a distance matrix
PAIRS = 65_536      # pairs whose exact distance is computed at once


class Tree:
    """centres of all nodes; children as (first, last + 1) of consecutive nodes, (0, 0) for a
    leaf; number, cell and nodes of the leaves."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf: int | None = None, seed: int = 1):
        leaf = leaf or max(8, math.isqrt(len(sample)) // 2)
        centres, self.children, todo = [sample.mean(axis=0)], [(0, 0)], [(0, np.arange(len(sample)))]
        cell_of = [0]
        while todo:
            node, rows = todo.pop()
            groups = _kmeans(sample[rows], min(branch, -(-len(rows) // leaf)), seed + node) if len(rows) > leaf else []
            if len(groups) < 2:
                continue
            first = len(centres)
            self.children[node] = (first, first + len(groups))
            for i, g in enumerate(groups):
                centres.append(sample[rows[g]].mean(axis=0))
                self.children.append((0, 0))
                cell_of.append(i if node == 0 else cell_of[node])
                todo.append((first + i, rows[g]))
        self.centres = np.array(centres)
        self.norms = (self.centres ** 2).sum(axis=1)
        self.leaf_nodes = np.array([i for i, c in enumerate(self.children) if c == (0, 0)])
        self.leaf_of = np.full(len(centres), -1)
        self.leaf_of[self.leaf_nodes] = np.arange(len(self.leaf_nodes))
        self.cells = np.array(cell_of)[self.leaf_nodes]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row: the nearest child, level by level."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            first, end = self.children[node]
            if first == end:
                out[rows] = self.leaf_of[node]
                continue
            near = (self.norms[first:end] - 2 * x[rows] @ self.centres[first:end].T).argmin(axis=1)
            todo += [(first + i, rows[near == i]) for i in np.unique(near)]
        return out

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of the rows to all nodes' centres."""
        d = (x ** 2).sum(axis=1)[:, None] + self.norms - 2 * x @ self.centres.T
        return np.maximum(np.nan_to_num(d, nan=np.inf), 0)

    def walk(self, d: np.ndarray, visits: int, counts: np.ndarray, rows: int) -> list[int]:
        """Leaves in best-bin-first order for one query with squared distances `d`: at least
        `visits`, and until they hold `rows` rows."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or held < rows):
            node = heapq.heappop(queue)[1]
            while self.children[node] != (0, 0):
                first, end = self.children[node]
                best = first + int(d[first:end].argmin())
                for c in range(first, end):
                    if c != best:
                        heapq.heappush(queue, (d[c], c))
                node = best
            out.append(int(self.leaf_of[node]))
            held += counts[out[-1]]
        return out


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> list[np.ndarray]:
    """Row numbers of up to k clusters (k-means++ start, Lloyd rounds); equal rows: one cluster."""
    rng = np.random.RandomState(seed % 2**31)
    centres = [x[rng.randint(len(x))]]
    low = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and np.isfinite(low.sum()) and low.sum() > 0:
        centres.append(x[rng.choice(len(x), p=low / low.sum())])
        low = np.minimum(low, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        near = ((c ** 2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
    near = ((c ** 2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
    return [np.flatnonzero(near == i) for i in np.unique(near)]


def _first(query: np.ndarray, dist: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k entries of every query by (distance, place)."""
    order = np.lexsort((place, dist, query))
    q = query[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[rank < k]


def nearest(q: np.ndarray, q_row: np.ndarray, tau: np.ndarray, c: np.ndarray, c_row: np.ndarray, place: np.ndarray,
            k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, distance) of the first k candidates of each query, its own row left
    out, at distances up to its `tau`: found by products, ordered by exact distances."""
    out, step = [], max(1, GRID // max(1, len(c)))
    norms = (c ** 2).sum(axis=1)
    for at in range(0, len(q), step):
        x, limit = q[at:at + step], tau[at:at + step]
        size = (x ** 2).sum(axis=1)[:, None] + norms
        d = size - 2 * x @ c.T
        own = q_row[at:at + step, None] == c_row[None, :]
        d[own] = np.inf
        slack = 1e-9 * size.max(axis=1)
        high = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(x), np.inf)
        bar = np.minimum(high, limit ** 2) + slack
        i, j = np.nonzero(~(d > bar[:, None]) & ~own)
        exact = np.concatenate([np.sqrt(((x[i[p:p + PAIRS]] - c[j[p:p + PAIRS]]) ** 2).sum(axis=1))
                                for p in range(0, max(len(i), 1), PAIRS)])
        fine = exact <= limit[i]
        i, j, exact = i[fine], j[fine], exact[fine]
        kept = _first(i, exact, place[j], k)
        out.append((i[kept] + at, j[kept], exact[kept]))
    return tuple(np.concatenate(p) for p in zip(*out)) if out else (np.empty(0, np.int64),) * 2 + (np.empty(0),)


def fit(rows: DataFrame, dim: int, n: int) -> tuple[Tree, np.ndarray, np.ndarray]:
    """The tree, and the sample it was fitted on: (row numbers, vectors)."""
    size = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * max(dim, 1))))
    part = rows if n <= size else rows.filter(F.pmod(F.xxhash64("row", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * size / n))
    table = part.select("row", "vec").toArrow()
    order = np.argsort(table["row"].to_numpy())
    x = matrix(table["vec"], dim)[order]
    return Tree(x), table["row"].to_numpy()[order], x


def assigned(rows: DataFrame, tree: Tree, dim: int) -> DataFrame:
    """`rows` (row, id, vec) with leaf, cell and distance from the leaf's centre, written."""
    common.ship(rows.sparkSession)
    names = ["row", "id", "vec", "leaf", "cell", "radius"]

    def run(batches):
        for b in batches:
            x = matrix(b.column(2), dim)
            leaf = tree.assign(x)
            radius = np.sqrt(((x - tree.centres[tree.leaf_nodes[leaf]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(leaf, pa.int32()),
                                              pa.array(tree.cells[leaf], pa.int32()), pa.array(radius)], names=names)

    return common.stage(rows.select("row", "id", "vec").mapInArrow(
        run, "row long, id long, vec array<double>, leaf int, cell int, radius double"), "leaves")


def calibrate(index: DataFrame, tree: Tree, counts: np.ndarray, own: np.ndarray, x: np.ndarray, k: int,
              recall: float = RECALL) -> int:
    """The least number of leaves with which the calibration rows (numbers `own`, vectors `x`)
    find the share `recall` of their exact k nearest rows of the whole index."""
    far, dim = np.full(len(x), np.inf), x.shape[1]

    def run(batches):
        best = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
        for b in batches:
            row = b.column(0).to_numpy()
            i, j, d = nearest(x, own, far, matrix(b.column(1), dim), row, np.arange(len(row)), k)
            best = [np.concatenate(p) for p in zip(best, (i, d, b.column(2).to_numpy()[j].astype(np.int64), row[j]))]
            kept = _first(best[0], best[1], best[3], k)
            best = tuple(p[kept] for p in best)
        yield pa.RecordBatch.from_arrays([pa.array(p) for p in best], names=["query", "dist", "leaf", "row"])

    found = index.select("row", "vec", "leaf").mapInArrow(run, "query long, dist double, leaf long, row long")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("dist", "row"))).filter(F.col("n") <= k)
    places: list[int] = []
    orders: dict[int, dict[int, int]] = {}
    dist = tree.distances(x)
    for r in best.select("query", "leaf").collect():          # at most k rows for each calibration row
        if r["query"] not in orders:
            walk = tree.walk(dist[r["query"]], len(counts), counts, 0)
            orders[r["query"]] = {leaf: i for i, leaf in enumerate(walk)}
        places.append(orders[r["query"]][r["leaf"]])
    visits, found_at = 1, np.bincount(places, minlength=1) if places else np.ones(1)
    reached = found_at[0]
    while reached < recall * found_at.sum():
        reached += found_at[visits]
        visits += 1
    return visits


def route(queries: DataFrame, tree: Tree, dim: int, visits: int, counts: np.ndarray, radius: np.ndarray, k: int) -> DataFrame:
    """(row, id, vec, round, cell, leaves, lows) of each query's visits by cell: round 0 the
    first eighth; `lows` bounds the distance of any row of the leaf from below. Written."""
    early = -(-visits // 8)
    names = ["row", "id", "vec", "round", "cell", "leaves", "lows"]

    def run(batches):
        for b in batches:
            x = matrix(b.column(2), dim)
            scale = np.sqrt((x ** 2).sum(axis=1))
            for at in range(0, len(x), 256):
                d = tree.distances(x[at:at + 256])
                take, col = [], {n: [] for n in names[3:]}
                for i in range(len(d)):
                    walk = [leaf for leaf in tree.walk(d[i], visits, counts, k + 1) if counts[leaf]]
                    low = np.sqrt(d[i, tree.leaf_nodes[walk]]) - radius[walk]
                    low = np.nan_to_num(low - 1e-6 * (radius[walk] + scale[at + i]), nan=-np.inf, neginf=-np.inf)
                    by: dict[tuple[int, int], list[int]] = {}
                    held = 0
                    for v, leaf in enumerate(walk):
                        by.setdefault((0 if v < early or held <= k else 1, int(tree.cells[leaf])), []).append(v)
                        held += counts[leaf]
                    for (turn, cell), vs in by.items():
                        take.append(at + i)
                        for n, value in zip(names[3:], (turn, cell, [walk[v] for v in vs], [float(low[v]) for v in vs])):
                            col[n].append(value)
                kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(take, pa.int64())) for i in range(3)]
                                                 + [pa.array(col[n], t) for n, t in zip(names[3:], kinds)], names=names)

    return common.stage(queries.mapInArrow(
        run, "row long, id long, vec array<double>, round int, cell int, leaves array<int>, lows array<double>"), "routes")


def visit(index: DataFrame, routed: DataFrame, dim: int, cell_rows: np.ndarray, blocks: int, k: int) -> DataFrame:
    """(query, query_id, row, vec_id, score): the first k rows of every query in each tile,
    among the leaves it visits, at distances up to its `tau`."""
    tiles = F.element_at(F.array(*[F.lit(max(1, -(-int(c) // TILE))) for c in cell_rows]), F.col("cell") + 1)
    keys = ["cell", "tile", "block"]
    left = index.select("row", "id", "vec", "leaf", "cell", spread(F.col("row"), tiles).alias("tile"),
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = routed.select("row", "id", "vec", "leaves", "tau", "cell",
                          F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), spread(F.col("row"), blocks).alias("block"))
    kinds = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()),
                       ("score", pa.float64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(rows) or not len(queries):
            return kinds.empty_table()
        c, c_row, leaf, place = matrix(rows["vec"], dim), rows["row"].to_numpy(), rows["leaf"].to_numpy(), order_of_ids(rows["id"])
        q, q_row, tau = matrix(queries["vec"], dim), queries["row"].to_numpy(), queries["tau"].to_numpy()
        lists = queries["leaves"].combine_chunks()
        at, wanted = lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy()
        found = []
        for x in np.intersect1d(leaf, wanted):
            i, j = at[wanted == x], np.flatnonzero(leaf == x)
            a, b, d = nearest(q[i], q_row[i], tau[i], c[j], c_row[j], place[j], k)
            found.append((i[a], j[b], d))
        if not found:
            return kinds.empty_table()
        i, j, d = (np.concatenate(p) for p in zip(*found))
        kept = _first(i, d, place[j], k)
        i, j, d = pa.array(i[kept]), pa.array(j[kept]), pa.array(d[kept])
        return pa.Table.from_arrays([queries["row"].take(i), queries["id"].take(i), rows["row"].take(j), rows["id"].take(j), d],
                                    schema=kinds)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        run, "query long, query_id long, row long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy("score", F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", vec: str = "embedding",
           recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id `every` divides."""
    spark = vectors.sparkSession
    rows, dim, n = usable(vectors, vec_id, vec, nonzero=True)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree, sample_rows, sample = fit(rows, dim, n)
    index = assigned(rows, tree, dim)
    counts, radius = np.zeros(len(tree.leaf_nodes), np.int64), np.zeros(len(tree.leaf_nodes))
    for r in index.groupBy("leaf").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).collect():  # one row a leaf
        counts[r["leaf"]], radius[r["leaf"]] = r["n"], r["radius"]
    pick = np.random.RandomState(3).permutation(len(sample))[:CALIBRATION]
    visits = calibrate(index, tree, counts, sample_rows[pick], sample[pick], k, recall)
    queries = index.filter(F.col("id") % every == 0).select("row", "id", "vec")
    blocks = max(1, -(-queries.count() // BLOCK))
    routed = route(queries, tree, dim, visits, counts, radius, k)
    cell_rows = np.bincount(tree.cells, weights=counts)
    near = routed.filter("round = 0").withColumn("tau", F.lit(float("inf")))
    found = common.stage(_ranked(visit(index, near, dim, cell_rows, blocks, k), k), "near")
    tau = found.filter(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("tau"))
    later = routed.filter("round = 1").join(tau, "row", "left").withColumn("tau", F.coalesce("tau", F.lit(float("inf"))))
    open_ = F.filter(F.arrays_zip("leaves", "lows"), lambda e: e["lows"] <= F.col("tau"))
    later = later.withColumn("leaves", F.transform(open_, lambda e: e["leaves"])).filter(F.size("leaves") > 0)
    more = visit(index, later, dim, cell_rows, blocks, k)
    return _ranked(found.drop("rank").unionByName(more), k).select("query_id", "rank", "vec_id", "score")
