"""Aggregations (G1-G4, G6) and total-based unit filters.

All aggregates are declarative, so Spark runs a partial aggregation on every map
task before the shuffle: a unit that holds a third of the rows contributes one
partial row per task, not a third of the data, to a single reducer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.agg import agg_expr, window_agg
from ..spec import PanelSpec


def group_agg(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, tuple[str, str]],
              strict: bool = False) -> DataFrame:
    """{out: (fn, column)} per group. strict=True: a group with any null input
    gets null (NA-propagating); strict=False skips nulls."""
    return df.groupBy(*keys).agg(*[agg_expr(fn, c, strict).alias(o) for o, (fn, c) in aggs.items()])


def resample(df: DataFrame, spec: PanelSpec, period: Column | str, measures: Sequence[str] | Mapping[str, str],
             how: str = "mean", strict: bool = True, period_name: str | None = None) -> DataFrame:
    """Down-sample a unit series to a coarser period (e.g. ISO week): one row per
    (unit, period) with the mean (or other `how`) of each measure."""
    pcol = F.col(period) if isinstance(period, str) else period
    pname = period_name or (period if isinstance(period, str) else "period")
    m = dict(measures) if isinstance(measures, Mapping) else {c: c for c in measures}
    return (df.groupBy(*spec.unit, pcol.alias(pname))
            .agg(*[agg_expr(how, src, strict).alias(out) for out, src in m.items()]))


def group_stat(df: DataFrame, keys: Sequence[str], c: str, fn: str = "mean", out: str | None = None,
               strict: bool = False) -> DataFrame:
    """A group statistic attached to every row of the group (window over the group;
    the group is a unit, so a partition is one unit's rows)."""
    w = Window.partitionBy(*keys)
    e = agg_expr(fn, c, strict).over(w)
    return df.withColumn(out or f"{c}_{fn}", e)


def summarize(df: DataFrame, c: str, where: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample sd, min and max of `c` (optionally only rows matching `where`)."""
    d = df.filter(where) if where is not None else df
    x = F.col(c)
    aggs = [F.count(x).cast("bigint").alias("obs"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
            F.min(x).alias("min"), F.max(x).alias("max")]
    return d.groupBy(*by).agg(*aggs) if by else d.agg(*aggs)


def unit_totals(df: DataFrame, spec: PanelSpec, c: str, out: str = "total", strict: bool = True) -> DataFrame:
    """One row per unit with the (strict) sum of `c`."""
    return df.groupBy(*spec.unit).agg(agg_expr("sum", c, strict).alias(out))


def filter_units_by_total(df: DataFrame, spec: PanelSpec, c: str, min_total, out: str = "total",
                          strict: bool = True, totals_from: DataFrame | None = None) -> DataFrame:
    """F3 (+J4): attach each unit's total of `c` and keep units whose total >= min_total.
    A null total (strict and a missing value) fails the test. `totals_from` computes the
    totals on another frame (e.g. before a date cut)."""
    if totals_from is None:
        # one pass: the total is a window over the unit (the partitioning series windows use)
        tot_col = window_agg("sum", c, spec.unit_window(), strict)
        return df.withColumn(out, tot_col).filter(F.col(out) >= F.lit(min_total))
    tot = unit_totals(totals_from, spec, c, out, strict)
    return df.join(tot, list(spec.unit), "left").filter(F.col(out) >= F.lit(min_total))
