"""Sources and sinks.

Stages are parquet folders: columnar, splittable, with filter and column pushdown.
Writes go through Spark's commit protocol (task output is only published when the
job commits), so a lost executor just re-runs its tasks.
"""

from __future__ import annotations

import csv
import os
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str, cols: Sequence[str] | None = None) -> DataFrame:
    """One driver table; `cols` prunes the parquet scan to the listed columns."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*cols) if cols else df


def read_wide_csv(spark: SparkSession, path: str, id_schema: T.StructType, value_type: str = "bigint",
                  encoding: str = "UTF-8") -> DataFrame:
    """A header-row CSV with id columns plus one value column per time step.

    Id columns get the given types; every other column is a value column cast to
    `value_type` (text that does not parse becomes null). No schema inference pass
    over the data: only the header line is read to learn the column names.
    """
    raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
    ids = {f.name: f.dataType for f in id_schema.fields}
    out = []
    for c in raw.columns:
        if c in ids:
            out.append(F.col(f"`{c}`").try_cast(ids[c]).alias(c) if hasattr(F.col(c), "try_cast")
                       else F.col(f"`{c}`").cast(ids[c]).alias(c))
        else:
            out.append(F.col(f"`{c}`").try_cast(value_type).alias(c))
    return raw.select(*out)


# One field of a CSV line: quoted (a quote inside it doubled or after a backslash), or up to the next comma.
_FIELD = r'(?:^|,)("(?:[^"\\]|\\.|"")*"|[^,]*)'


def _fields(line: Column) -> Column:
    """The fields of a CSV line as an array; an empty field is null, a quoted empty one is empty."""
    quoted = F.transform(F.regexp_extract_all(line, F.lit(_FIELD), F.lit(1)), lambda f: F.when(
        f.startswith('"'), F.regexp_replace(F.regexp_replace(F.substring(f, 2, F.length(f) - 2), r'\\(.)', "$1"), '""', '"')).otherwise(F.nullif(f, F.lit(""))))
    plain = F.transform(F.split(line, ",", -1), lambda f: F.nullif(f, F.lit("")))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(plain)


def read_wide_csv_long(spark: SparkSession, path: str, id_schema: T.StructType, prefix: str, index: str, value: str,
                       value_type: str = "bigint", encoding: str = "UTF-8") -> DataFrame:
    """S1 + P1 in one: a header-row CSV with one value column ``<prefix><number>`` per time step, read
    straight into rows (ids..., index, value).

    Each line is split once into an array and exploded by position, so the plan holds two literals,
    not one column per time step, and its size does not grow with the steps. The header line is read
    first and dropped wherever it occurs (every part file has one). Fields may be quoted; a quoted
    field must not hold a line break. Text that does not parse, and a field a short line lacks, is null."""
    lines = spark.read.option("encoding", encoding).text(path)
    head = lines.filter(F.length("value") > 0).first()
    if head is None:
        raise ValueError(f"no header line in {path}")
    names = next(csv.reader([head[0].lstrip("\ufeff")]))
    at = [i for i, n in enumerate(names) if n.startswith(prefix) and n[len(prefix):].isdigit()]
    if not at:
        raise ValueError(f"no columns named {prefix}<number>")
    # literals as one string each: an array built of literals would be a node per time step
    listed = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<int>")
    rows = lines.filter((F.col("value") != head[0]) & (F.length("value") > 0)).select(_fields(F.col("value")).alias("__f"))
    pick = lambda i: F.try_element_at("__f", F.lit(i + 1))
    ids = [pick(names.index(f.name)).try_cast(f.dataType).alias(f.name) for f in id_schema.fields if f.name in names]
    field = F.transform(F.sequence(F.lit(0), F.lit(len(at) - 1)), lambda k: F.struct(
        F.element_at(listed([names[i][len(prefix):] for i in at]), k + 1).alias("i"),
        F.try_element_at("__f", F.element_at(listed([i + 1 for i in at]), k + 1)).try_cast(value_type).alias("v")))
    out = rows.select(*ids, F.explode(field).alias("__e"))
    return out.select(*[f.name for f in id_schema.fields if f.name in names], F.col("__e.i").alias(index), F.col("__e.v").alias(value))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True,
             encoding: str = "UTF-8") -> DataFrame:
    """Long CSV with an explicit schema (no inference pass)."""
    return (spark.read.schema(schema).option("header", header).option("encoding", encoding)
            .option("mode", "PERMISSIVE").csv(path))


def stage_path(root: str, name: str) -> str:
    return os.path.join(root, name)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it names it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_stage(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Re-open a saved stage. Where a job died between putting the old copy aside and the new
    one in its place, the old copy is read."""
    path = stage_path(root, name)
    fs, p = _files(spark, path)
    return spark.read.parquet(path if fs.exists(p) else f"{path}{_ASIDE}")


_ASIDE = ".aside"


def write_stage(df: DataFrame, root: str, name: str, partition_by: Iterable[str] | None = None) -> str:
    """Save a stage, replacing it. With `partition_by`, only the partitions present
    in `df` are replaced (dynamic partition overwrite), so one cohort can be rewritten
    without touching the others. Refuses to overwrite a stage the plan itself reads.

    A whole stage is written next to the old one and swapped in by renaming once it is complete, so
    a job that dies leaves the old stage in place (or, between the two renames, aside, where
    `read_stage` finds it)."""
    path = stage_path(root, name)
    norm = os.path.abspath(path.replace("file:", ""))
    for f in df.inputFiles():
        if os.path.abspath(f.replace("file:", "")).startswith(norm + os.sep):
            raise ValueError(f"stage {name!r} is an input of the plan being written; write elsewhere")
    if partition_by:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
        return path
    spark = df.sparkSession
    new = f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(new)
    fs, there = _files(spark, path)
    aside, fresh = _files(spark, f"{path}{_ASIDE}")[1], _files(spark, new)[1]
    if fs.exists(there):
        fs.delete(aside, True)
        if not fs.rename(there, aside):
            raise OSError(f"cannot put the old stage {path} aside")
    if not fs.rename(fresh, there):
        raise OSError(f"cannot move the new stage to {path}")
    fs.delete(aside, True)
    return path


def export_csv(df: DataFrame, path: str) -> str:
    """CSV report with a header row (one file per task; no single-file funnel)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
