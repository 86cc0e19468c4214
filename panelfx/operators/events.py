"""First-exposure events (E1, E2, W14) and event-relative flags."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import col
from ..functions.scalar import post_flag
from ..spec import PanelSpec


def first_exposure_wide(df: DataFrame, spec: PanelSpec, flags: Mapping[str, str | Column]) -> DataFrame:
    """E1 (wide): one row per unit, one column per definition holding the earliest time
    the definition's flag is 1 (null when never). All definitions in one aggregate."""
    t = F.col(spec.time)
    return df.groupBy(*spec.unit).agg(*[F.min(F.when(col(f) == 1, t)).alias(name) for name, f in flags.items()])


def first_exposure(df: DataFrame, spec: PanelSpec, flags: Mapping[str, str | Column],
                   definition: str = "definition", event_time: str = "event_time") -> DataFrame:
    """(unit..., definition, event_time) for every unit with at least one exposure."""
    wide = first_exposure_wide(df, spec, flags)
    long = wide.unpivot(list(spec.unit), list(flags), definition, event_time)
    return long.filter(F.col(event_time).isNotNull())


def mark_first_exposure(df: DataFrame, spec: PanelSpec, flags: Mapping[str, str | Column],
                        first_prefix: str = "first_", time_suffix: str = "_day1",
                        events: DataFrame | None = None) -> DataFrame:
    """For every definition, `first_<name>` = 1 and `<name>_day1` = time on the unit's
    first-exposure row, null elsewhere. One window over the unit for all definitions.
    `events` lets the first times come from another frame (e.g. before a date cut), by one
    aggregate and one join."""
    t = F.col(spec.time)
    if events is None:
        w = spec.unit_window()
        df = df.withColumns({f"__ev_{n}": F.min(F.when(col(f) == 1, t)).over(w) for n, f in flags.items()})
        return _markers(df, spec, flags, first_prefix, time_suffix)
    ev = first_exposure_wide(events, spec, flags)
    ev = ev.select(*spec.unit, *[F.col(n).alias(f"__ev_{n}") for n in flags])
    return _markers(df.join(ev, list(spec.unit), "left"), spec, flags, first_prefix, time_suffix)


def _markers(df: DataFrame, spec: PanelSpec, flags, first_prefix: str, time_suffix: str) -> DataFrame:
    """Marker columns from the unit's first times (__ev_<name>), which are dropped."""
    t, cols = F.col(spec.time), {}
    for n in flags:
        hit = t == F.col(f"__ev_{n}")
        cols[f"{first_prefix}{n}"] = F.when(hit, F.lit(1))
        cols[f"{n}{time_suffix}"] = F.when(hit, t)
    return df.withColumns(cols).drop(*[f"__ev_{n}" for n in flags])


def first_rows(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Each unit's earliest row (ties impossible: the panel is unique on unit-time)."""
    t0 = F.min(spec.time).over(spec.unit_window())          # one pass, no join back
    return df.withColumn("__t0", t0).filter(F.col(spec.time) == F.col("__t0")).drop("__t0")


def post_period(df: DataFrame, t: str, event: str, out: str = "X") -> DataFrame:
    """1 from the event time on; a missing event gives 0 everywhere."""
    return df.withColumn(out, post_flag(t, event))


def treated_flag(unit: Column, treated_unit: Column, t: Column | None = None, event: Column | None = None) -> Column:
    """1 for the treated unit (from its event time on when `t`/`event` are given), else 0."""
    cond = F.coalesce(unit == treated_unit, F.lit(False))
    if t is not None and event is not None:
        cond = cond & F.coalesce(t >= event, F.lit(False))
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))
