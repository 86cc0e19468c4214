"""Confidence interval recovered from an estimate and its p-value.

Uses the published approximation z = -0.862 + sqrt(0.743 - 2.404 ln p)
(Altman & Bland, BMJ 2011), se = -estimate / z, and a normal critical value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

# Fixed values of the approximation and of the 90 % interval.
Z_A = -0.862
Z_B = 0.743
Z_C = 2.404
Z_CRIT_90 = 1.645
P_FLOOR = 0.0001


def z_from_p(p, floor: float = P_FLOOR) -> Column:
    """z from a p-value; p = 0 is floored first (log of 0 is undefined)."""
    p = col(p)
    pf = F.when(p == 0, F.lit(floor)).otherwise(p)
    return F.lit(Z_A) + F.sqrt(F.lit(Z_B) - F.lit(Z_C) * F.log(pf))


def ci_columns(est, p, z_crit: float = Z_CRIT_90, floor: float = P_FLOOR) -> dict[str, Column]:
    """Columns zval, se, upper_ci, lower_ci, ci_low, ci_high.

    upper_ci / lower_ci keep the source formulas (est -/+ z_crit*se with se = -est/z): for a
    negative estimate upper_ci < lower_ci. ci_low / ci_high are the ordered bounds and are
    null when z <= 0 (p close to 1: the approximation breaks down and se explodes).
    """
    e = col(est)
    z = z_from_p(p, floor)
    se = -e / z
    upper = e - F.lit(z_crit) * se
    lower = e + F.lit(z_crit) * se
    ok = z > 0
    return {
        "zval": z,
        "se": se,
        "upper_ci": upper,
        "lower_ci": lower,
        "ci_low": F.when(ok, F.least(upper, lower)),
        "ci_high": F.when(ok, F.greatest(upper, lower)),
    }
