"""Stage 2 -- diagnose and smooth the compiled unit-day panel.

smoothed(df)      daily counts from totals (first day 0), negative days reported and
                  replaced by the previous day's value, counties still negative
                  dropped, 7/14-day rolling sums, 7-day lags, four ratios, weeks >= 20
diagnostics(sm)   outlier / NaN / Inf counties (reports only)
daily_panel(sm)   0/0 -> 0, counties with >= 100 deaths, exposure flags, ids,
                  first-exposure markers, June cut
weekly_panel(sm)  weekly means and the same flags and markers by week

`smoothed` is the fork of the two panels: materialize it (``session.materialize``)
or write it when both are built.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import iso_week, member_flag, ratio, threshold_flag, zero_over_zero
from ..operators import aggregate, events, panel, quality, series
from ..spec import PanelSpec

# Fixed values of the analysis.
ELIGIBLE_UNITS = ["Alameda County", "Contra Costa County", "Marin County", "San Francisco County",
                  "Santa Clara County", "Sonoma County"]
ELIGIBLE_STATE = "CA"
TIME_ORIGIN = _dt.date(2019, 12, 31)       # time = days since this date (day of year 2020)
ANALYSIS_START = _dt.date(2020, 6, 1)
MIN_WEEK = 20
MIN_TOTAL_DEATHS = 100
KEEP = ["countyname", "state", "day", "countyfips", "statefips", "date", "date2", "total_cases", "total_d",
        "light", "medium", "heavy", "light_pct", "medium_pct", "heavy_pct", "eligible", "week",
        "populationstayingathome", "populationnotstayingathome"]
CUTS = {"heavy_smoke_p50": ("heavy_pct", 50.0), "heavy_smoke_p70": ("heavy_pct", 70.0),
        "heavy_smoke_p90": ("heavy_pct", 90.0), "medium_smoke_p70": ("medium_pct", 70.0)}
EVENTS = {"heavy50": "heavy_smoke_p50", "heavy70": "heavy_smoke_p70", "heavy90": "heavy_smoke_p90",
          "medium70": "medium_smoke_p70"}
RATIOS = {"CFR7_lag7": ("death_roll_7d", "cases_roll_7d_lag7"),
          "CFR14_lag7": ("death_roll_14d", "cases_roll_14d_lag7"),
          "CFR7_same_day": ("death_roll_7d", "cases_roll_7d"),
          "CFR14_same_day": ("death_roll_14d", "cases_roll_14d")}

COUNTY = PanelSpec(("countyname", "state"), "day")


def prepare(df: DataFrame) -> DataFrame:
    """Eligibility flag and ISO week."""
    return df.withColumns({
        "eligible": member_flag("countyname", ELIGIBLE_UNITS, F.col("state") == ELIGIBLE_STATE),
        "week": iso_week("date"),
    })


def negative_reports(df: DataFrame) -> dict[str, DataFrame]:
    """Rows with negative daily cases / deaths before repair (for export)."""
    d = _daily(df)
    return {"cases": quality.report_negative(d, ["cases"]), "death": quality.report_negative(d, ["death"])}


def _daily(df: DataFrame) -> DataFrame:
    d = panel.select_present(df, KEEP)
    return d.withColumns({"cases": series.decumulate_expr(COUNTY, "total_cases", "zero"),
                          "death": series.decumulate_expr(COUNTY, "total_d", "zero")})


def smoothed(df: DataFrame) -> DataFrame:
    d = _daily(df)
    d = series.repair_negative(d, COUNTY, ["cases", "death"], "previous")
    d = quality.drop_units_where(d, COUNTY, (F.col("cases") < 0) | (F.col("death") < 0))
    d = d.withColumns({"cases_roll_7d": series.rolling_sum_expr(COUNTY, "cases", 7),
                       "death_roll_7d": series.rolling_sum_expr(COUNTY, "death", 7),
                       "cases_roll_14d": series.rolling_sum_expr(COUNTY, "cases", 14),
                       "death_roll_14d": series.rolling_sum_expr(COUNTY, "death", 14)})
    d = d.withColumns({"cases_roll_7d_lag7": series.lag_expr(COUNTY, "cases_roll_7d", 7),
                       "cases_roll_14d_lag7": series.lag_expr(COUNTY, "cases_roll_14d", 7)})
    d = d.withColumns({n: ratio(a, b, "ieee") for n, (a, b) in RATIOS.items()})
    return d.filter(F.col("week") >= MIN_WEEK)


def diagnostics(sm: DataFrame) -> dict[str, DataFrame]:
    cols = list(RATIOS)
    fixed = _zero_over_zero(sm)
    return {"outlier": quality.units_failing(sm, COUNTY, quality.outlier_cond(cols)),
            "nan_before": quality.units_failing(sm, COUNTY, quality.nan_cond(cols)),
            "nan_after": quality.units_failing(fixed, COUNTY, quality.nan_cond(cols)),
            "inf": quality.units_failing(fixed, COUNTY, quality.inf_cond(cols))}


def _zero_over_zero(sm: DataFrame) -> DataFrame:
    return sm.withColumns({n: zero_over_zero(a, b, n) for n, (a, b) in RATIOS.items()})


def _flags_ids_events(df: DataFrame, time_col: str, spec: PanelSpec, suffix: str) -> DataFrame:
    df = df.withColumns({n: threshold_flag(c, cut) for n, (c, cut) in CUTS.items()})
    df = panel.dense_unit_id(df, ["countyname", "state"], out="id")
    return events.mark_first_exposure(df, spec, EVENTS, first_prefix="first_smoke_", time_suffix=suffix) \
        .withColumnsRenamed({f"{n}{suffix}": f"smoke_{n}{suffix}" for n in EVENTS})


def daily_panel(sm: DataFrame) -> DataFrame:
    d = _zero_over_zero(sm)
    d = aggregate.filter_units_by_total(d, COUNTY, "death", MIN_TOTAL_DEATHS, out="tot_covid")
    d = d.withColumn("time", F.datediff(F.col("date"), F.lit(TIME_ORIGIN)))
    d = _flags_ids_events(d, "time", PanelSpec(("countyname", "state"), "time"), "_day1")
    return d.filter(F.col("date") >= F.lit(ANALYSIS_START))


WEEKLY_MEANS = {"CFR7_lag7": "CFR7_lag7", "CFR14_lag7": "CFR14_lag7", "CFR7_same_day": "CFR7_same_day",
                "CFR14_same_day": "CFR14_same_day", "heavy_pct": "heavy_pct", "medium_pct": "medium_pct",
                "death_roll_7d": "death_roll_7d", "cases_roll_7d": "cases_roll_7d",
                "mobility": "populationstayingathome", "mobility2": "populationnotstayingathome"}


def weekly_panel(sm: DataFrame) -> DataFrame:
    d = _zero_over_zero(sm)
    w = aggregate.resample(d, COUNTY, "week", WEEKLY_MEANS, how="mean", strict=True)
    tot = aggregate.unit_totals(d, COUNTY, "death", "tot_covid")
    w = w.join(tot, list(COUNTY.unit), "left").filter(F.col("tot_covid") >= MIN_TOTAL_DEATHS)
    w = w.filter(F.col("week") >= MIN_WEEK).withColumn("time", F.col("week"))
    w = _flags_ids_events(w, "time", PanelSpec(("countyname", "state"), "time"), "_week1")
    return w.withColumn("eligible", member_flag("countyname", ELIGIBLE_UNITS, F.col("state") == ELIGIBLE_STATE))


UNSMOOTHED_MEANS = {"CFR_same_day": "CFR_same_day", "CFR_14days": "CFR_14dys", "CFR_7_14days": "CFR_7_14days",
                    "death": "death", "heavy_pct": "heavy_pct", "mobility1": "populationstayingathome",
                    "mobility2": "populationnotstayingathome"}
SMOKE_CUT = 70.0


def _first_smoke(df: DataFrame) -> DataFrame:
    """smoke_bin, id, first_smoke and smoke_week1 (the time of the first row over the cut)."""
    df = df.withColumn("smoke_bin", threshold_flag("heavy_pct", SMOKE_CUT))
    df = panel.dense_unit_id(df, ["countyname", "state"], out="id")
    df = events.mark_first_exposure(df, PanelSpec(COUNTY.unit, "time"), {"smoke": "smoke_bin"}, "first_", "_week1")
    return df


def unsmoothed_panels(df: DataFrame) -> dict[str, DataFrame]:
    """Weekly and daily panels of the compiled ratios, without smoothing, of counties with
    enough deaths, from the first analysed week on. `df` is the output of ``prepare``; it
    is read twice, so pass a written stage."""
    tot = aggregate.unit_totals(df, COUNTY, "death", "tot_covid")
    enough = lambda d: d.join(tot, list(COUNTY.unit), "left").filter(
        (F.col("tot_covid") >= MIN_TOTAL_DEATHS) & (F.col("week") >= MIN_WEEK))
    weekly = enough(aggregate.resample(df, COUNTY, "week", UNSMOOTHED_MEANS, how="mean", strict=True))
    weekly = _first_smoke(weekly.withColumn("time", F.col("week")))
    weekly = weekly.withColumn("eligible", member_flag("countyname", ELIGIBLE_UNITS, F.col("state") == ELIGIBLE_STATE))
    daily = enough(df).withColumn("time", F.datediff(F.col("date"), F.lit(TIME_ORIGIN)))
    return {"weekly": weekly, "daily": _first_smoke(daily)}
