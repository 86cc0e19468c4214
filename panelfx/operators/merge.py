"""Joins and set operations.

Joins are declared and left to the planner: Spark broadcasts a side only when its
estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` (and AQE re-checks
with runtime sizes), otherwise it shuffles both sides on the keys and AQE splits
skewed key partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HOW = {"all": "full_outer", "match": "inner", "left": "left", "right": "right"}


# A value of each key type that stands for null once a flag column tells the two apart.
_FILLER = {T.StringType: "", T.BooleanType: False, T.DateType: "1970-01-01", T.TimestampType: "1970-01-01 00:00:00",
           T.TimestampNTZType: "1970-01-01 00:00:00", T.BinaryType: ""}


def _null_safe_keys(df: DataFrame, keys: Sequence[str], types: dict[str, T.DataType], flags: Sequence[bool]) -> dict[str, Column]:
    """Columns that are never null and equal exactly where the keys are, null being a value like
    any other. Being columns, they serve a window, a sort and a join with one exchange."""
    out = {}
    for i, (k, flag) in enumerate(zip(keys, flags)):
        c = F.col(k).cast(types[k])
        if not flag:
            out[f"__k{i}"] = c
            continue
        filler = F.lit(_FILLER.get(type(types[k]), 0)).cast(types[k])
        out[f"__k{i}"], out[f"__n{i}"] = F.coalesce(c, filler), F.col(k).isNull()
    return out


def _once(df: DataFrame, keys: Sequence[str], on: Sequence[str], side: str) -> DataFrame:
    """`df`, failing when it runs if a key occurs twice: the rows are numbered within their key
    on the exchange and sort of the join itself, so the input is read once."""
    w = Window.partitionBy(*on).orderBy(*on)
    says = F.concat(F.lit(f"keys {list(keys)} are not unique on the {side} side, e.g. "), F.to_json(F.struct(*keys)))
    fine = F.when(F.row_number().over(w) == 1, F.lit(True)).otherwise(F.raise_error(says).cast("boolean"))
    return df.withColumn("__once", fine).filter("__once").drop("__once")


def merge_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], keep: str = "all",
                     indicator: str | None = None, validate: bool = True) -> DataFrame:
    """1:1 merge on `keys`, a null key being a value like any other.

    keep="all" keeps every row of both sides, "match" only matched rows, "left" the
    left rows (with matches), "right" the right rows. A non-key column present on both
    sides takes the left value whenever a left row exists -- even a null one -- and the
    right value only for right-only rows. `indicator` adds 1 = left only, 2 = right
    only, 3 = both. That the keys are unique on each side is asserted inside the plan, on the
    merge's own exchange and sort: the job fails where they are not, and nothing runs before it.
    `validate=False` is for sides that are unique by construction, such as the output of a
    groupBy on the keys.
    """
    keys = list(keys)
    fields = {s: {f.name: f for f in df.schema.fields} for s, df in (("left", left), ("right", right))}
    types = {k: fields["left"][k].dataType for k in keys}
    flags = [fields["left"][k].nullable or fields["right"][k].nullable for k in keys]
    plain = [flag and (isinstance(types[k], T.NumericType) or type(types[k]) in _FILLER) for k, flag in zip(keys, flags)]
    if plain != flags:
        raise TypeError(f"merge keys must be numbers, strings, dates, times, booleans or binary, not {types}")
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    sides = []
    for df, side, mark in ((left, "left", "l"), (right, "right", "r")):
        safe = _null_safe_keys(df, keys, types, flags)
        df = df.withColumns(safe)
        if validate:
            df = _once(df, keys, list(safe), side)
        sides.append(df.select(*safe, *[F.col(c).alias(f"__{mark}_{c}") if c in shared or c in keys else F.col(c) for c in df.columns
                                        if c not in safe], F.lit(True).alias(f"__{mark}")))
    j = sides[0].join(sides[1], list(safe), _HOW[keep])
    lp, rp = F.col("__l").isNotNull(), F.col("__r").isNotNull()
    out = j.withColumns({c: F.when(lp, F.col(f"__l_{c}")).otherwise(F.col(f"__r_{c}")) for c in [*keys, *shared]})
    if indicator:
        out = out.withColumn(indicator, F.when(lp & rp, 3).when(lp, 1).otherwise(2))
    order = keys + [c for c in left.columns if c not in keys] + \
        [c for c in right.columns if c not in keys and c not in shared] + ([indicator] if indicator else [])
    return out.select(*order)


def natural_left_join(left: DataFrame, right: DataFrame, null_safe: bool = False,
                      on: Sequence[str] | None = None) -> DataFrame:
    """Left join on every shared column (or `on`).

    null_safe=True matches null to null on every key column (including doubles), the
    data-frame convention; otherwise SQL equality (null never matches)."""
    keys = list(on) if on is not None else [c for c in left.columns if c in right.columns]
    if not null_safe:
        return left.join(right, keys, "left")
    r = right.select(*[F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys])
    return left.join(r, cond, "left").drop(*[f"__k_{c}" for c in keys])


def drop_matching(df: DataFrame, bad: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `df` whose keys do not appear in `bad` (left anti join)."""
    return df.join(bad.select(*keys), list(keys), "left_anti")


def append(*dfs: DataFrame) -> DataFrame:
    """Stack rows by column name; a column absent on one side is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct combinations of the listed columns."""
    return df.select(*cols).distinct()
