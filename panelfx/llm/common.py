"""What the text operators share: Arrow mapping over whole texts, row keys, written stages.

Row key. Several operators work on a slim table and come back to the documents. The key
they come back by is the document id together with the 64-bit hash of its text
(``row_key``): rows that repeat in full share a key and get the same result, rows that
share only an id stay apart, and a null id is a key like any other (joins compare ids
null-safely).
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelfx import session

# Rows and bytes of text handed to a mapping function at once; bounds its temporary lists.
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20

# Rows and bytes of an Arrow batch between Spark and Python. Spark's own bound is rows alone, 10,000, so
# long texts make batches of many MB: in the JVM outside its heap, rounded up to a power of two.
BATCH_ROWS = 2_048
BATCH_BYTES = 4 << 20

# Rows of a side that may be broadcast: a key and a few numbers each, under 150 MB in all.
BROADCAST_ROWS = 1_000_000


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application: tasks import its functions,
    and a cluster need not have it installed. Spark's own file server hands the archive out."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(), f"{package.name}-{app}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)


def small_batches(spark: SparkSession) -> None:
    """Bound this session's Arrow batches; smaller bounds of the session's own stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(-?\d+)b?", str(spark.conf.get(key)).lower())
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def local_frame(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A frame of a few rows the driver has. From Arrow: a frame from Python rows would start Python
    workers for their pickles, apart from those of the mapping functions."""
    return spark.createDataFrame(pa.table(columns))


def text_slices(col: pa.Array, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive slices of a text column, bounded in rows and bytes (`most`);
    a single text over the bound is a slice of its own."""
    start = size = 0
    lengths = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or size + n > most):
            yield start, i - start
            start, size = i, 0
        size += n
    if len(lengths) > start:
        yield start, len(lengths) - start


def map_texts(df: DataFrame, text: str, fields: list[T.StructField],
              fn: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """`df` without its text column plus `fields`, which `fn` computes from slices of texts.

    The whole column is processed, a slice at a time, so a task holds one Arrow batch and
    one slice. `fields` must not clash with the other columns of `df`; callers select a
    slim frame or use `free_name`.
    """
    return _map(df, text, fields, fn, keep_text=False)


def append_texts(df: DataFrame, text: str, fields: list[T.StructField],
                 fn: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """As `map_texts`, with every column of `df` kept."""
    return _map(df, text, fields, fn, keep_text=True)


def _map(df, text, fields, fn, keep_text):
    ship(df.sparkSession)
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    at = [i for i, f in enumerate(df.schema.fields) if keep_text or f.name != text]
    col_at = df.schema.fieldNames().index(text)
    schema = T.StructType(kept + fields)
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            col = batch.column(col_at)
            for start, n in text_slices(col):
                out = [batch.column(i).slice(start, n) for i in at]
                out += fn(col.slice(start, n).to_pylist())
                yield pa.RecordBatch.from_arrays(out, names=names)

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, base: str) -> str:
    """`base`, lengthened until no column of `df` has the name (any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_hash(text: Column) -> Column:
    """64-bit hash of the text; a null text hashes like no empty one."""
    return F.xxhash64(text.isNull(), text)


def join_key(docs: DataFrame, doc_id: str, text: str, side: DataFrame, how: str) -> DataFrame:
    """`docs` joined by its row key to `side` (columns id, h, and others whose names are
    free in `docs`); the key's own columns do not come along."""
    i, h = free_name(docs, "__id"), free_name(docs, "__h")
    side = side.withColumnsRenamed({"id": i, "h": h})
    out = docs.join(side, docs[doc_id].eqNullSafe(side[i]) & (text_hash(docs[text]) == side[h]), how)
    return out if how in ("left_semi", "left_anti") else out.drop(i, h)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet under the shared folder named by ``spark.checkpoint.dir`` and
    return the written copy: a fork reads it instead of computing it again, readers prune
    its columns, and a lost executor costs no recomputation above it."""
    ship(df.sparkSession)
    return session.materialize(df, name)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; deleted with the application's other stages."""
    ship(spark)
    return session.shared_path(spark, name)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` (a written stage: counting it reads file footers) with a broadcast hint if it
    has at most `rows` rows; beyond that the planner joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df
