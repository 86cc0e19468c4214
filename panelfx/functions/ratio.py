"""Ratio and sign expressions (N1-N3, P13). All are plain Column expressions,
so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

_INF = float("inf")


def ratio(num, den, mode: str = "null") -> Column:
    """num / den as double.

    mode="null": a zero denominator gives null (missing-value convention).
    mode="ieee": 0/0 -> NaN, x/0 -> +Inf or -Inf by the sign of x (floating-point convention).
    A null on either side gives null in both modes.
    """
    n, d = col(num).cast("double"), col(den).cast("double")
    if mode == "null":
        return F.try_divide(n, d)
    if mode == "ieee":
        return (F.when(d == 0, F.when(n == 0, F.lit(float("nan")))
                       .when(n > 0, F.lit(_INF))
                       .when(n < 0, F.lit(-_INF)))
                .otherwise(F.try_divide(n, d)))
    raise ValueError(f"unknown ratio mode {mode!r}")


def null_if_negative(c) -> Column:
    """Negative -> null; null stays null; NaN is kept (NaN >= 0 is true in Spark)."""
    c = col(c)
    return F.when(c >= 0, c)


def zero_over_zero(num, den, value) -> Column:
    """Where both numerator and denominator are 0 the ratio is defined as 0."""
    return F.when((col(num) == 0) & (col(den) == 0), F.lit(0.0)).otherwise(col(value))


def finite_or_null(c) -> Column:
    """N3 boundary rule: NaN and +-Inf become null (missing) before estimation."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(_INF)), F.lit(None).cast("double")).otherwise(c)


def sign_flag(c) -> Column:
    """1 when negative, else 0. A missing value gives 0 (it is not negative)."""
    return F.when(col(c) < 0, F.lit(1)).otherwise(F.lit(0))


def is_outlier(c, limit: float = 1.0) -> Column:
    """True when c > limit; +Inf counts, NaN does not (Spark orders NaN above +Inf)."""
    c = col(c)
    return F.coalesce((c > limit) & ~F.isnan(c), F.lit(False))


def is_nan(c) -> Column:
    return F.coalesce(F.isnan(col(c)), F.lit(False))


def is_inf(c) -> Column:
    return F.coalesce(col(c) == F.lit(_INF), F.lit(False))
