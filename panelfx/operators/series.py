"""Series operators inside a unit.

All of them are window expressions over ``Window.partitionBy(unit).orderBy(time)``.
Expressions that share that spec are evaluated by one Exchange + Sort + Window, so
chaining several of them in one ``withColumns`` costs a single shuffle on the unit.
A unit's series is bounded by the calendar length, so no window partition grows
with the raw data. Offsets are by row (the previous row of the unit), matching
the source scripts; run ``complete_panel`` first when calendar offsets are meant.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import PanelSpec


def _names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def decumulate_expr(spec: PanelSpec, c: str, first: str = "total") -> Column:
    """Cumulative total -> per-step change.

    first="total": the unit's first row keeps the total itself.
    first="zero":  the unit's first row is 0 (null when the total is null).
    first="null":  the unit's first row is null.
    A null total, or a null previous total, gives null.
    """
    w = spec.window()
    x = F.col(c)
    diff = x - F.lag(x, 1).over(w)
    head = {"total": x, "zero": x - x, "null": F.lit(None)}[first]
    return F.when(F.row_number().over(w) == 1, head).otherwise(diff)


def decumulate(df: DataFrame, spec: PanelSpec, cols, first: str = "total", suffix: str = "") -> DataFrame:
    """W1/W2 for one or more cumulative columns (one Window operator for all)."""
    return df.withColumns({f"{c}{suffix}": decumulate_expr(spec, c, first) for c in _names(cols)})


def repair_negative_expr(spec: PanelSpec, c: str, how: str = "null") -> Column:
    """Negative values repaired.

    how="null":      negative -> null                                      (W3)
    how="previous":  negative -> the previous row's original value, once;
                     that value may itself be negative (no cascade)        (W4)
    how="last_good": negative -> last earlier non-negative value of the unit,
                     null when there is none                               (W5)
    Null inputs stay null in every mode.
    """
    x = F.col(c)
    if how == "null":
        return F.when(x >= 0, x)
    w = spec.window()
    if how == "previous":
        return F.when(x < 0, F.lag(x, 1).over(w)).otherwise(x)
    if how == "last_good":
        good = F.last(F.when(x >= 0, x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return F.when(x < 0, good).otherwise(x)
    raise ValueError(f"unknown repair {how!r}")


def repair_negative(df: DataFrame, spec: PanelSpec, cols, how: str = "null", suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": repair_negative_expr(spec, c, how) for c in _names(cols)})


def lag_expr(spec: PanelSpec, c: str, k: int) -> Column:
    """Value k rows earlier in the unit (null for the first k rows)."""
    return F.lag(F.col(c), k).over(spec.window())


def lag_cols(df: DataFrame, spec: PanelSpec, cols, k: int, suffix: str | None = None) -> DataFrame:
    sfx = suffix if suffix is not None else f"_lag{k}"
    return df.withColumns({f"{c}{sfx}": lag_expr(spec, c, k) for c in _names(cols)})


def lagged_mean_expr(spec: PanelSpec, c: str, first_lag: int = 14, last_lag: int = 8) -> Column:
    """Mean of the values first_lag..last_lag rows earlier; null unless all exist and are
    non-null. The sum runs oldest-to-newest and is divided once."""
    n = first_lag - last_lag + 1
    w = spec.frame(-first_lag, -last_lag)
    x = F.col(c)
    return F.when(F.count(x).over(w) == n, F.sum(x).over(w) / F.lit(float(n)))


def lagged_mean(df: DataFrame, spec: PanelSpec, c: str, first_lag: int = 14, last_lag: int = 8,
                out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{c}_avg{last_lag}_{first_lag}", lagged_mean_expr(spec, c, first_lag, last_lag))


def rolling_sum_expr(spec: PanelSpec, c: str, n: int) -> Column:
    """Right-aligned sum of the last n rows; null when fewer than n rows exist or one
    of them is null (NA padding and NA propagation)."""
    w = spec.frame(-(n - 1), 0)
    x = F.col(c)
    return F.when(F.count(x).over(w) == n, F.sum(x).over(w))


def rolling_sum(df: DataFrame, spec: PanelSpec, cols, n: int, suffix: str | None = None) -> DataFrame:
    sfx = suffix if suffix is not None else f"_roll{n}"
    return df.withColumns({f"{c}{sfx}": rolling_sum_expr(spec, c, n) for c in _names(cols)})


def interpolate_gap_expr(spec: PanelSpec, c: str) -> Column:
    """A null between two non-null rows becomes their mean; longer gaps stay null.

    Equivalent to the sequential "replace if missing" loop: a filled row needs both
    neighbours present, so a fill never feeds another fill."""
    w = spec.window()
    x = F.col(c)
    return F.coalesce(x, (F.lag(x, 1).over(w) + F.lead(x, 1).over(w)) / F.lit(2.0))


def interpolate_gap(df: DataFrame, spec: PanelSpec, cols: Iterable[str] | str) -> DataFrame:
    return df.withColumns({c: interpolate_gap_expr(spec, c) for c in _names(cols)})


def fill_from(df: DataFrame, target: str, source: str) -> DataFrame:
    """Take `source` where `target` is missing."""
    return df.withColumn(target, F.coalesce(F.col(target), F.col(source)))
