"""Aggregate expressions with the two missing-value conventions.

strict=True  -> any missing input makes the result missing (NA-propagating sums/means)
strict=False -> missing inputs are skipped (SQL / Spark default)

Both are plain declarative aggregates, so Spark runs them as partial (map-side)
+ final aggregation -- a hot group is pre-combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

_FUNCS = {
    "sum": F.sum,
    "mean": F.avg,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "sd": F.stddev_samp,
}


def complete(c) -> Column:
    """True when no input row of the group is null (NaN counts as present)."""
    return F.count(F.lit(1)) == F.count(col(c))


def agg_expr(fn: str, c, strict: bool = False) -> Column:
    f = _FUNCS[fn]
    e = f(col(c))
    if strict:
        e = F.when(complete(c), e)
    return e


def strict_sum(c) -> Column:
    return agg_expr("sum", c, strict=True)


def strict_avg(c) -> Column:
    return agg_expr("mean", c, strict=True)


def window_agg(fn: str, c, w, strict: bool = False) -> Column:
    """`agg_expr` evaluated over a window (each row gets its group's value): one pass over
    the input instead of an aggregate joined back to it."""
    x = col(c)
    e = _FUNCS[fn](x).over(w)
    if strict:
        e = F.when(F.count(F.lit(1)).over(w) == F.count(x).over(w), e)
    return e
