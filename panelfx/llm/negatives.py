"""Hard-negative mining: anchors times candidates by Strassen's multiplication, in tiles.

Vectors become integers (floor of 256 x). A block of anchors (m x d) times a tile of
candidates (d x n) is one product: Strassen's seven half-size products, recursively, on
int64 with odd sides padded by zeros, until a side is at most `CUT`; only integer additions
and multiplications, so scores are exact. Rows whose scores could leave the range (100 times
a score must fit a long) take no part.

Positives first: a block of one label's anchors meets the tiles of the same label, each
returning for every anchor the heap of its five first rows (higher score, then smaller id).
Heaps merge by keeping the first five of their union. Then windows: each block meets the
tiles of all candidates, and for every anchor and positive a tile returns the heap of the
first five rows of another label inside the window of that positive's score; they merge alike.

Distribution. Tiles have about `TILE` rows and blocks `BLOCK` anchors whatever their labels,
dealt by row number: a label, or one vector, with a third of all rows is many tiles. A task
holds one block, one tile and their product. No pair of rows leaves a task but heap entries.

Defined results. Null labels, null vectors and null or non-finite components take no part,
nor do lengths other than the most frequent (see `vectors`); zero vectors do. Null ids are
candidates, last among equal scores, and never anchors. Rows that share an id or repeat in full
are rows of their own; each anchor row is answered for itself. No positive, or none in the window:
no row. Empty table: no rows. Other columns, whatever their names, are not read. There is no text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .vectors import matrix, order_of_ids, spread, usable

TILE = 4_096
BLOCK = 512
CUT = 32
KEPT = 5


def strassen(a: np.ndarray, b: np.ndarray, cut: int = CUT) -> np.ndarray:
    """a @ b for int64 matrices by seven products of half size, zero-padded to even sides."""
    m, d, n = *a.shape, b.shape[1]
    if min(m, d, n) <= cut:
        return a @ b
    if m % 2 or d % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, d % 2)))
        b = np.pad(b, ((0, d % 2), (0, n % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, cut)
    p2 = strassen(a21 + a22, b11, cut)
    p3 = strassen(a11, b12 - b22, cut)
    p4 = strassen(a22, b21 - b11, cut)
    p5 = strassen(a11 + a12, b22, cut)
    p6 = strassen(a21 - a11, b11 + b12, cut)
    p7 = strassen(a12 - a22, b21 + b22, cut)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j], out[:h, j:] = p1 + p4 - p5 + p7, p3 + p5
    out[h:, :j], out[h:, j:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def _in_order(rows: pa.Table) -> pa.Table:
    """By id, so that a stable sort by score breaks ties by the smaller id."""
    return rows.take(pa.array(np.argsort(order_of_ids(rows["id"]))))


_POSITIVE = pa.schema([("anchor", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
_NEGATIVE = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("row", pa.int64()), ("id", pa.int64()),
                       ("score", pa.int64())])


def _positives(dim: int, kept: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return _POSITIVE.empty_table()
        rows = _in_order(rows)
        scores = strassen(matrix(anchors["vec"], dim, np.int64), matrix(rows["vec"], dim, np.int64).T)
        mine, theirs = anchors["row"].to_numpy(), rows["row"].to_numpy()
        out_a, out_c = [], []
        for i, s in enumerate(scores):
            first = np.argsort(-s, kind="stable")[:kept + 1]
            first = first[theirs[first] != mine[i]][:kept]
            out_a.append(np.full(len(first), i))
            out_c.append(first)
        i, j = np.concatenate(out_a), np.concatenate(out_c)
        return pa.Table.from_arrays([pa.array(mine[i]), pa.array(theirs[j]), rows["id"].take(pa.array(j)).combine_chunks(),
                                     pa.array(scores[i, j])], schema=_POSITIVE)
    return run


def _windows(dim: int, kept: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return _NEGATIVE.empty_table()
        rows = _in_order(rows)
        scores = strassen(matrix(anchors["vec"], dim, np.int64), matrix(rows["vec"], dim, np.int64).T)
        label, theirs = anchors["label"].to_numpy(), rows["label"].to_numpy()
        positives = anchors["positives"].to_pylist()
        out = []
        for i, s in enumerate(scores):
            other = np.flatnonzero(theirs != label[i])
            order = other[np.argsort(-s[other], kind="stable")]
            falling = -100 * s[order]
            for place, p in enumerate(positives[i]):
                start = np.searchsorted(falling, -high * p, side="left")
                first = order[start:start + kept]
                first = first[100 * s[first] >= low * p]
                out += [(i, place, j) for j in first]
        i, place, j = (np.array(x, np.int64) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3
        return pa.Table.from_arrays([anchors["row"].take(pa.array(i)).combine_chunks(), pa.array(place.astype(np.int32)),
                                     rows["row"].take(pa.array(j)).combine_chunks(),
                                     rows["id"].take(pa.array(j)).combine_chunks(), pa.array(scores[i, j])], schema=_NEGATIVE)
    return run


def _pairs(anchors: DataFrame, rows: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """`run` on every (block of anchors, tile of rows) that shares its keys."""
    own = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])     # both sides stem from one table
    return own.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, schema)


def _merge(heaps: DataFrame, keys: list[str], kept: int) -> DataFrame:
    """The first `kept` of each key's heaps."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return heaps.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= kept)


def hard_negatives(vectors: DataFrame, every: int = 100, kept: int = KEPT, low: int = 80, high: int = 100, vec_id: str = "vec_id",
                   vec: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each
    anchor (row whose id `every` divides) and each of its first `kept` positives, the first
    `kept` rows of another label with low * positive <= 100 * negative <= high * positive."""
    spark = vectors.sparkSession
    tag = F.col(label).cast("long")
    rows, dim, n = usable(vectors.filter(F.col(label).isNotNull()), vec_id, vec, keep={"label": tag})
    limit = math.isqrt((2**63 - 1) // (max(low, high, 100) * max(dim, 1)))
    whole = F.transform("vec", lambda x: F.floor(x * 256.0))
    rows = rows.filter(F.forall("vec", lambda x: F.abs(x * 256.0) < float(limit))) \
        .select("row", "id", "label", whole.alias("vec"))
    rows = common.stage(rows, "integers")
    is_anchor = F.coalesce(F.col("id") % every == 0, F.lit(False))
    anchors = rows.filter(is_anchor)

    sizes = common.stage(rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(is_anchor.cast("long")).alias("a"))
                         .filter("a > 0").select("label", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"),
                                                 F.ceil(F.col("a") / BLOCK).cast("int").alias("blocks")), "labels")
    few = common.bounded(sizes)
    keys = ["label", "tile", "block"]
    tile, block = spread(F.col("row"), F.col("tiles")).alias("tile"), spread(F.col("row"), F.col("blocks")).alias("block")
    mine = anchors.join(few, "label").select("row", "vec", "label", block, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    theirs = rows.join(few, "label").select("row", "id", "vec", "label", tile,
                                            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    heaps = _pairs(mine, theirs, keys, _positives(dim, kept), "anchor long, row long, id long, score long")
    positives = common.stage(_merge(heaps, ["anchor"], kept), "positives")

    packed = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p")) \
        .select(F.col("anchor").alias("row"), F.transform("p", lambda x: x["score"]).alias("positives"))
    asked = common.stage(anchors.drop("id").join(packed, "row"), "anchors")
    tiles, blocks = max(1, -(-rows.count() // TILE)), max(1, -(-asked.count() // BLOCK))
    keys = ["tile", "block"]
    mine = asked.select("*", spread(F.col("row"), blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    theirs = rows.select("*", spread(F.col("row"), tiles).alias("tile"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = _merge(_pairs(mine, theirs, keys, _windows(dim, kept, low, high),
                          "anchor long, place int, row long, id long, score long"), ["anchor", "place"], kept)
    named = positives.select("anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return found.join(named, ["anchor", "place"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
