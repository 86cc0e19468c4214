"""Scalar column builders: dates, weeks, flags, labels."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

# The source data stores dates as whole days since this epoch.
DAY_EPOCH = _dt.date(1960, 1, 1)


def index_to_date(index, base: _dt.date | str, offset: int = 0, step_days: int = 1) -> Column:
    """A time index (e.g. the numeric suffix of a wide column) -> DATE
    base + (index + offset) * step_days."""
    b = F.lit(base if isinstance(base, str) else base.isoformat()).cast("date")
    return F.date_add(b, ((col(index) + F.lit(offset)) * F.lit(step_days)).cast("int"))


def epoch_day_to_date(days) -> Column:
    """Whole days since 1960-01-01 -> DATE."""
    return index_to_date(days, DAY_EPOCH)


def date_to_epoch_day(d) -> Column:
    return F.datediff(col(d), F.lit(DAY_EPOCH.isoformat()).cast("date"))


def parse_date(c, fmt: str = "yyyyMMdd") -> Column:
    """Number or text -> DATE. Unparseable input gives null instead of failing the job."""
    return F.try_to_date(col(c).cast("string"), fmt) if hasattr(F, "try_to_date") \
        else F.to_date(col(c).cast("string"), fmt)


def iso_week(c) -> Column:
    """P10: ISO-8601 week number (1..53) of a date; no year, as in the source data."""
    return F.weekofyear(col(c))


def week_start(c) -> Column:
    """Monday of the ISO week as a DATE."""
    return F.to_date(F.date_trunc("week", col(c)))


def relative_time(t, origin) -> Column:
    """T - origin for numbers; days between for dates."""
    t, o = col(t), (origin if isinstance(origin, Column) else F.lit(origin))
    return t - o


def threshold_flag(c, cut: float) -> Column:
    """1 when c >= cut, 0 when c < cut, null when c is null or NaN."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("int")).when(c >= cut, F.lit(1)).when(c < cut, F.lit(0))


def threshold_flags(cuts: Mapping[str, tuple[str, float]]) -> dict[str, Column]:
    """{flag_name: (column, cut)} -> {flag_name: flag expression}, for withColumns."""
    return {name: threshold_flag(c, cut) for name, (c, cut) in cuts.items()}


def member_flag(c, values: Iterable, and_cond: Column | None = None, yes="Yes", no="No") -> Column:
    """yes/no flag for `c in values AND and_cond` (values is a short literal list)."""
    cond = col(c).isin(list(values))
    if and_cond is not None:
        cond = cond & and_cond
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(yes)).otherwise(F.lit(no))


def clean_label(*cols, remove: Iterable[str] = (" ",)) -> Column:
    """Concatenate text columns and delete every listed substring (literal, not regex)."""
    out = F.concat(*[col(c) for c in cols]) if len(cols) > 1 else col(cols[0])
    for s in remove:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


def post_flag(t, event) -> Column:
    """1 from the event time on, else 0; a missing event time gives 0."""
    return F.when(col(t) >= col(event), F.lit(1)).otherwise(F.lit(0))
