"""Vector tables as the two vector operators read them.

`usable` numbers the rows and writes them once: (row, id, vec, further columns). `row` tells
rows apart that share an id or repeat in full, so "every other row" has one meaning.
Vectors that are null or hold a null or non-finite component take no part; where vectors
differ in length, those of the most frequent length (the shortest of equally frequent ones)
do and the others take no part, as no distance to them is defined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def usable(df: DataFrame, vec_id: str, vec: str, keep: dict[str, Column] | None = None,
           nonzero: bool = False) -> tuple[DataFrame, int, int]:
    """(row long, id long, vec array<double>, `keep`) of the rows that take part, written; the
    length of the vectors and the number of rows. Of an empty table both are 0."""
    x = F.transform(F.col(vec), lambda e: e.cast("double"))
    fine = F.forall("vec", lambda e: e.isNotNull() & (F.abs(F.coalesce(e, F.lit(0.0))) < float("inf")))
    if nonzero:
        fine = fine & F.exists("vec", lambda e: e != 0.0)
    slim = df.select(F.col(vec_id).cast("long").alias("id"), x.alias("vec"),
                     *[c.alias(n) for n, c in (keep or {}).items()])
    out = common.stage(slim.filter(F.col("vec").isNotNull() & fine)
                       .withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = out.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return out, 0, 0
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    return out.filter(F.size("vec") == dim), dim, n


def matrix(col: pa.Array | pa.ChunkedArray, dim: int, kind=np.float64) -> np.ndarray:
    """Rows of equal-length lists as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(len(col), dim)


def order_of_ids(ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The place of every row in the order of the ids, nulls last; equal ids by position."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    missing = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), missing))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def spread(row: Column, parts: Column | int) -> Column:
    """A part number from 0 to `parts` - 1, even whatever the rows hold."""
    parts = parts if isinstance(parts, Column) else F.lit(parts)
    return F.pmod(F.xxhash64(row, F.lit(17)), parts.cast("long")).cast("int")
