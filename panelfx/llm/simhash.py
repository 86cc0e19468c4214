"""SimHash near-duplicates by a segment-popcount embedding (operator 5).

Fingerprint: 64 bits, bit b set if it is set in over half the XXH64 hashes of the text's
word shingles. Two fingerprints are linked at `max_bits` or fewer differing bits.

Candidates. The 64 bits are cut into 32 segments of two bits; a fingerprint is embedded as
its 32 segment bit counts. The Manhattan distance of two embeddings is a lower bound of
their Hamming distance, so linked fingerprints are at most `max_bits` apart there, and at
most max_bits // 2 apart in one half of the segments. The range join over a half meets in
the middle: a point is filed under every grid cell within max_bits // 4 (rounded up) steps
of it, and two points within max_bits // 2 of each other share such a cell. Every pair in
a cell is verified on the fingerprints themselves.

Scale: equal fingerprints are one row before any join. A cell's rows are read in sorted
order; cells are compared in numpy and give only the edges of verified links. A cell of
over CELL rows is not compared where it is found: its rows are dealt to tiles, one group
for each pair of blocks of half as many rows, so no task holds an unbounded cell. Components come from
``components``; documents get their class by an equi-join on the fingerprint.

Defined results. Null or empty text: no words, fingerprint zero, linked like any other.
Fewer words than a shingle: the whole sequence is the one shingle. Rows that repeat: each
returned, one class. Null ids: never the smallest; a class of null ids alone has a null
class id. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

SHINGLE = 4      # words
MAX_BITS = 4     # differing bits of a link
CELL = 16_384    # rows of a cell compared in one task

SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ODD = 0x5555555555555555  # the lower bit of each two-bit segment


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 of every shingle of a text, repeats included."""
    words = text.encode().translate(LOWER).split() if text else []
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[:n - shingle + 1].tolist(), ends[shingle - 1:].tolist())),
                       np.uint64, n - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint as a signed 64-bit integer."""
    n = len(hashes)
    if n == 0:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounds the unpacked bits of a very long text
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`df` without `text`, plus `fp` (a signed 64-bit integer) of every whole text."""
    def fn(texts):
        return [pa.array([majority(shingle_hashes(t, shingle)) for t in texts], pa.int64())]

    return common.map_texts(df, text, [T.StructField("fp", T.LongType(), False)], fn)


# ------------------------------------------------------------------ embedding and grid

def embed(fps: np.ndarray) -> np.ndarray:
    """The 32 segment bit counts of each fingerprint, packed two bits each."""
    x = fps.view(np.uint64)
    return x - ((x >> np.uint64(1)) & np.uint64(ODD))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings (counts 0 to 2): |a - b| is 1 if one count is
    odd, 2 if both are even and differ."""
    x, odd = a ^ b, np.uint64(ODD)
    one = np.bitwise_count(x & odd).astype(np.int64)
    two = np.bitwise_count((x >> np.uint64(1)) & odd & ~x).astype(np.int64)
    # counts 1 and 2 differ in both bits, 0 and 1 in the lower bit, 0 and 2 in the upper bit
    return one + 2 * two


def cells(fps: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row): for each half, the grid cells within `steps` of each row's embedding."""
    vec = embed(fps)
    all_keys, all_rows = [], []
    for half in (0, 1):
        keys = (vec >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        rows = np.arange(len(fps))
        found = [(keys, rows)]
        for _ in range(steps):  # each step moves one segment's count by one
            keys, rows = found[-1]
            moved = []
            for s in range(16):
                unit = np.uint64(1 << (2 * s))
                count = (keys >> np.uint64(2 * s)) & np.uint64(3)
                up, down = count < 2, count > 0
                moved += [(keys[up] + unit, rows[up]), (keys[down] - unit, rows[down])]
            found.append((np.concatenate([k for k, _ in moved]), np.concatenate([r for _, r in moved])))
        keys = np.concatenate([k for k, _ in found])
        rows = np.concatenate([r for _, r in found])
        if steps > 1:  # different orders of the same steps meet in one cell
            pairs = np.unique(np.stack([keys, rows.astype(np.uint64)]), axis=1)
            keys, rows = pairs[0], pairs[1].astype(np.int64)
        all_keys.append(keys | np.uint64(half << 32))
        all_rows.append(rows)
    return np.concatenate(all_keys).view(np.int64), np.concatenate(all_rows)


# ------------------------------------------------------------------ verification

def close(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """The range test on the embeddings, then the exact test on the fingerprints."""
    near = manhattan(embed(a), embed(b)) <= max_bits
    near[near] = np.bitwise_count((a[near] ^ b[near]).view(np.uint64)) <= max_bits
    return near


def forest(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that join the members (distinct fingerprints) linked directly or through
    other members: a breadth-first search whose steps compare one member with all that are
    left, so at most one edge per member."""
    edges = []
    left = members
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = close(np.broadcast_to(x, left.shape).copy(), left, max_bits)
            if near.any():
                edges += [(int(x), int(y)) for y in left[near]]
                queue += list(left[near])
                left = left[~near]
    return edges


def links_in_cells(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> np.ndarray:
    """Verified links (n x 2) inside the cells of sorted `keys`: all pairs for cells of a
    few rows, compared lag by lag over all such cells at once, forests for larger ones."""
    bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([bounds, [len(keys)]]))
    few = np.repeat(sizes, sizes) <= 16
    k, f = keys[few], fps[few]
    out = []
    for lag in range(1, 16):
        same = np.flatnonzero(k[lag:] == k[:-lag]) if len(k) > lag else np.empty(0, np.int64)
        if len(same) == 0:
            break
        a, b = f[same], f[same + lag]
        ok = close(a, b, max_bits)
        out.append(np.stack([a[ok], b[ok]], axis=1))
    for at, n in zip(bounds[sizes > 16].tolist(), sizes[sizes > 16].tolist()):
        edges = forest(np.unique(fps[at:at + n]), max_bits)
        if edges:
            out.append(np.array(edges, np.int64))
    return np.unique(np.sort(np.concatenate(out), axis=1), axis=0) if out else np.empty((0, 2), np.int64)


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, cell: int = CELL) -> DataFrame:
    """(a, b): edges between distinct fingerprints that connect exactly those linked at
    `max_bits` or fewer differing bits, directly or through others. `fps`: one column fp,
    distinct. A cell of more than `cell` rows is dealt to tiles."""
    steps = -(-(max_bits // 2) // 2)
    filed = T.StructType([T.StructField("cell", T.LongType()), T.StructField("fp", T.LongType())])

    def file(batches):
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(f), 2048):
                part = f[at:at + 2048]
                key, row = cells(part, steps)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["cell", "fp"])

    # links: cell null; rows of a cell too large to compare here: b null
    found = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("cell", T.LongType())])

    def batch_of(edges=None, over=None):
        a, b, c = (pa.array(edges[:, 0]), pa.array(edges[:, 1]), pa.nulls(len(edges), pa.int64())) if over is None else \
            (pa.array(over[1]), pa.nulls(len(over[0]), pa.int64()), pa.array(over[0]))
        return pa.RecordBatch.from_arrays([a, b, c], names=["a", "b", "cell"])

    def compare(batches):
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.int64)
        spilled = None  # the cell whose rows are being passed on
        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False)])
            if spilled is not None:
                n = int(np.searchsorted(k, spilled, side="right"))
                if n:
                    yield batch_of(over=(k[:n], f[:n]))
                    k, f = k[n:], f[n:]
                if len(k) == 0:
                    held_k, held_f = k, f
                    continue
                spilled = None
            last = int(np.searchsorted(k, k[-1]))  # the last cell may go on in the next batch
            yield from whole(k[:last], f[:last])
            held_k, held_f = k[last:], f[last:]
            if len(held_k) > cell:
                spilled = held_k[0]
                yield batch_of(over=(held_k, held_f))
                held_k, held_f = held_k[:0], held_f[:0]
        yield from whole(held_k, held_f)

    def whole(k, f):
        if len(k) < 2:
            return
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        n = np.diff(np.concatenate([at, [len(k)]]))
        big = np.repeat(n, n) > cell
        if big.any():
            yield batch_of(over=(k[big], f[big]))
            k, f = k[~big], f[~big]
        if len(k) > 1:
            edges = links_in_cells(k, f, max_bits)
            if len(edges):
                yield batch_of(edges)

    filed_rows = fps.select("fp").mapInArrow(file, filed)
    out = filed_rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, found)
    out = common.stage(out, "links")
    direct = out.filter("cell IS NULL").select("a", "b")
    over = out.filter("cell IS NOT NULL").select("cell", F.col("a").alias("fp"))
    return direct.union(tiles(over, max_bits, cell)).distinct()


def tiles(over: DataFrame, max_bits: int, cell: int = CELL) -> DataFrame:
    """Links inside cells of any size: a cell's rows are dealt to blocks, and each pair of
    blocks is a task's group of about `cell` rows."""
    spec = over.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(1, cell // 2))).cast("int").alias("blocks"))
    rows = over.join(spec, "cell").withColumn("block", F.expr("cast(pmod(xxhash64(fp), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("cell", "fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        edges = np.array(forest(np.unique(table.column("fp").to_numpy()), max_bits), np.int64).reshape(-1, 2)
        return pa.table([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    return rows.groupBy("cell", "i", "j").applyInArrow(run, "a long, b long")


# ------------------------------------------------------------------ classes

def classes(df: DataFrame, doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """`df` (a written frame with `doc_id` and fp) plus component_id, the smallest id
    reachable through links, and root, the smallest fingerprint."""
    nodes = common.stage(df.groupBy("fp").agg(F.min(doc_id).alias("low")), "nodes")
    labels = components(fingerprint_links(nodes, max_bits))
    low = labels.join(nodes.withColumnRenamed("fp", "node"), "node").groupBy("label").agg(F.min("low").alias("root_low"))
    root = common.stage(labels.join(low, "label").select(F.col("node").alias("fp"), "root_low", "label"), "roots")
    # most fingerprints are linked to none: theirs is the class of their own equal texts
    whole = nodes.join(common.bounded(root), "fp", "left").select(
        "fp", F.coalesce("root_low", "low").alias("component_id"), F.coalesce("label", "fp").alias("root"))
    return df.join(whole, "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of `docs`: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    fps = common.stage(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle=shingle), "fps")
    out = classes(fps, "doc_id", max_bits)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """`docs` with one document of each class of near-duplicates: that with the smallest
    id, of rows that share it the one whose text hashes lowest, of rows that repeat in both
    one."""
    key = docs.select(F.col(doc_id).alias("id"), common.text_hash(F.col(text)).alias("h"), F.col(text).alias("text"))
    fps = common.stage(fingerprints(key, shingle=shingle), "fps")
    # a null id sorts last, so that it stays only where the class has no other
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h"))
    root = classes(fps, "id", max_bits)
    # a class is told apart by its smallest fingerprint: unlinked texts may share their smallest id
    kept = common.stage(root.groupBy("root").agg(first.alias("k")).select("k.id", "k.h"), "kept")
    out = common.join_key(docs, doc_id, text, kept, "left_semi")
    repeated = fps.groupBy("id", "h").count().filter("count > 1").limit(1).count() > 0
    if not repeated:
        return out
    whole = F.struct(*[F.col(c) for c in docs.columns])
    one = out.groupBy(F.col(doc_id).alias("k_id"), common.text_hash(F.col(text)).alias("k_h")).agg(F.first(whole).alias("row"))
    return one.select("row.*")
