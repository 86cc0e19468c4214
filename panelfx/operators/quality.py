"""Data-quality reports (D1-D5): rows or units failing a predicate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratio import is_inf, is_nan, is_outlier
from ..spec import PanelSpec


def any_of(preds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in preds])


def report_negative(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where any listed column is negative."""
    return df.filter(any_of([F.col(c) < 0 for c in cols]))


def units_failing(df: DataFrame, spec: PanelSpec, cond: Column, flag: str | None = None) -> DataFrame:
    """Distinct units with at least one row matching `cond` (null counts as no)."""
    out = df.filter(F.coalesce(cond, F.lit(False))).select(*spec.unit).distinct()
    return out.withColumn(flag, F.lit(1)) if flag else out


def outlier_cond(cols: Sequence[str], limit: float = 1.0) -> Column:
    """D3: any column above `limit`; +Inf counts, NaN does not."""
    return any_of([is_outlier(c, limit) for c in cols])


def nan_cond(cols: Sequence[str]) -> Column:
    """Any column NaN."""
    return any_of([is_nan(c) for c in cols])


def inf_cond(cols: Sequence[str]) -> Column:
    """Any column +Inf."""
    return any_of([is_inf(c) for c in cols])


def drop_units_where(df: DataFrame, spec: PanelSpec, cond: Column) -> DataFrame:
    """Drop every unit with at least one row matching `cond`, in one pass (a window flag
    over the unit) -- the single-frame form of units_failing + anti join."""
    bad = F.max(F.coalesce(cond, F.lit(False)).cast("int")).over(spec.unit_window())
    return df.withColumn("__bad", bad).filter(F.col("__bad") == 0).drop("__bad")
