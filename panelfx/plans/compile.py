"""Stage 1 -- compile: wide cumulative count files, a long exposure file and a long
mobility file into one unit-day panel.

Inputs (CSV, header row):
  counts   countyfips, countyname, state, statefips, v5, v6, ...  (cumulative totals; v5 = first day)
  exposure geoid, dates (yyyyMMdd), light, medium, heavy, light_pct, medium_pct, heavy_pct
  mobility level, date (y-m-d), statepostalcode, countyname, populationstayingathome,
           populationnotstayingathome

Everything is one lazy plan; `compile_panel` returns it and `write_stage` persists
it. Unit-day series windows partition by (state, countyname), so no task holds more
than one county's days.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import index_to_date, null_if_negative, parse_date, ratio, sign_flag
from ..operators import aggregate, merge, panel, quality, series
from ..sources.io import read_csv, read_wide_csv_long
from ..spec import PanelSpec

# Fixed values of the source files.
DAY_BASE = _dt.date(2020, 1, 17)           # day index 0; column v5 is 2020-01-22
FIRST_DAY = _dt.date(2020, 1, 22)
LAST_DAY = _dt.date(2020, 11, 10)
MISSING_EXPOSURE_DAYS = [_dt.date(2020, 7, 8)]     # absent from the exposure file for every county
# County names spelled differently in the case file, fixed before the merge.
CASE_NAME_FIXES = {
    "Alexandria City": "Alexandria city",
    "Broomfield County and City": "Broomfield County",
    "Charlottesville City": "Charlottesville city",
    "Chesapeake City": "Chesapeake city",
    "Danville City": "Danville city",
    "Fredericksburg City": "Fredericksburg city",
    "Harrisonburg City": "Harrisonburg city",
    "Lac Qui Parle County": "Lac qui Parle County",
    "Manassas City": "Manassas city",
    "Matthews County": "Mathews County",
    "Norfolk City": "Norfolk city",
    "Portsmouth City": "Portsmouth city",
    "Richmond City": "Richmond city",
    "Suffolk City": "Suffolk city",
    "Virginia Beach City": "Virginia Beach city",
}

ID_SCHEMA = T.StructType([
    T.StructField("countyfips", T.LongType()),
    T.StructField("countyname", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("statefips", T.LongType()),
])
EXPOSURE_SCHEMA = ("geoid long, dates long, light double, medium double, heavy double, "
                   "light_pct double, medium_pct double, heavy_pct double")
MOBILITY_SCHEMA = ("level string, date string, statepostalcode string, countyname string, "
                   "populationstayingathome double, populationnotstayingathome double")
EXPOSURE_MEASURES = ["light", "medium", "heavy", "light_pct", "medium_pct", "heavy_pct"]

COUNTY = PanelSpec(("state", "countyname"), "day")
FIPS_DAY = PanelSpec("countyfips", "date")


def _long_counts(counts: DataFrame, value: str) -> DataFrame:
    """Cumulative counts by county and day, from one column per day or already long (day, total)."""
    ids = [f.name for f in ID_SCHEMA.fields if f.name in counts.columns]
    long = counts.withColumnRenamed("total", value) if "day" in counts.columns else panel.wide_to_long(counts, ids, "v", "day", value)
    return long.withColumn("date", index_to_date("day", DAY_BASE))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """A wide count file as (ids, day, total) rows, its lines split once."""
    return read_wide_csv_long(spark, path, ID_SCHEMA, "v", "day", "total")


def deaths_stage(wide: DataFrame) -> DataFrame:
    """Daily deaths from cumulative totals; the first day keeps its total. Negative
    daily values are kept (they are reported, not repaired, at this stage)."""
    d = _long_counts(wide, "total_d")
    return d.withColumn("death", series.decumulate_expr(COUNTY, "total_d", "total"))


def cases_stage(wide: DataFrame, name_fixes: dict[str, str] = CASE_NAME_FIXES) -> DataFrame:
    """Daily cases; negative days flagged and set missing; 14-day lag and the mean of
    lags 14..8; county names fixed."""
    c = _long_counts(wide, "total_cases")
    c = c.withColumn("cases", series.decumulate_expr(COUNTY, "total_cases", "total"))
    c = c.withColumn("cases_neg", sign_flag("cases")).withColumn("cases", null_if_negative("cases"))
    c = c.withColumns({"cases_2wks": series.lag_expr(COUNTY, "cases", 14),
                       "cases_avg7_14": series.lagged_mean_expr(COUNTY, "cases", 14, 8)})
    return panel.recode(c, "countyname", name_fixes)


def health_stage(cases: DataFrame, deaths: DataFrame) -> DataFrame:
    """Cases x deaths (all rows of both kept; case-side values win) and three ratios with
    negative values nulled and flagged."""
    h = merge.merge_one_to_one(cases, deaths, ["state", "countyname", "day"], keep="all")
    out = {}
    for name, den in [("CFR_14dys", "cases_2wks"), ("CFR_same_day", "cases"), ("CFR_7_14days", "cases_avg7_14")]:
        r = ratio("death", den, "null")
        out[f"{name}_neg"] = sign_flag(r)
        out[name] = null_if_negative(r)
    return h.withColumns(out)


def negative_reports(deaths_wide: DataFrame, cases_wide: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """For daily deaths, daily cases and the 14-day ratio, before any of them is repaired: the
    summary of the negative values (G6) and the rows that hold them (D1)."""
    deaths = deaths_stage(deaths_wide)
    cases = _long_counts(cases_wide, "total_cases").withColumn("cases", series.decumulate_expr(COUNTY, "total_cases", "total"))
    both = merge.merge_one_to_one(cases_stage(cases_wide), deaths, ["state", "countyname", "day"], keep="all")
    both = both.withColumn("CFR_14dys", ratio("death", "cases_2wks", "null"))
    return {c: (aggregate.summarize(df, c, where=F.col(c) < 0), quality.report_negative(df, [c]))
            for df, c in ((deaths, "death"), (cases, "cases"), (both, "CFR_14dys"))}


def exposure_stage(raw: DataFrame, missing_days=MISSING_EXPOSURE_DAYS) -> DataFrame:
    """Exposure by county-day: every county gets a row for each day the file lacks
    (`missing_days`), then single-day gaps are filled with the neighbours' mean.
    Use `panel.complete_panel` instead to insert every absent day of the span."""
    e = raw.select(F.col("geoid").alias("countyfips"), parse_date("dates").alias("date"), *EXPOSURE_MEASURES)
    e = panel.insert_times(e, FIPS_DAY, missing_days)
    return series.interpolate_gap(e, FIPS_DAY, EXPOSURE_MEASURES)


def mobility_stage(raw: DataFrame) -> DataFrame:
    """County rows of the mobility file inside the study window."""
    d = F.coalesce(parse_date("date", "yyyy/MM/dd"), parse_date("date", "yyyy-MM-dd"))
    m = raw.filter(F.col("level") == "County").withColumn("date", d)
    m = m.filter((F.col("date") >= F.lit(FIRST_DAY)) & (F.col("date") <= F.lit(LAST_DAY)))
    return m.select(F.col("statepostalcode").alias("state"), "countyname", "date",
                    "populationstayingathome", "populationnotstayingathome")


def compile_panel(health: DataFrame, exposure: DataFrame, mobility: DataFrame) -> DataFrame:
    """Drop the unallocated county (fips 0; a missing fips is kept), keep county-days
    present in both health and exposure data, attach mobility where present."""
    h = health.filter((F.col("countyfips") != 0) | F.col("countyfips").isNull())
    he = merge.merge_one_to_one(h, exposure, ["countyfips", "date"], keep="match")
    return merge.merge_one_to_one(he, mobility, ["state", "countyname", "date"], keep="left")


def compile_from_files(spark: SparkSession, deaths_csv: str, cases_csv: str, exposure_csv: str,
                       mobility_csv: str) -> DataFrame:
    deaths = deaths_stage(read_counts(spark, deaths_csv))
    cases = cases_stage(read_counts(spark, cases_csv))
    exposure = exposure_stage(read_csv(spark, exposure_csv, EXPOSURE_SCHEMA))
    mobility = mobility_stage(read_csv(spark, mobility_csv, MOBILITY_SCHEMA))
    return compile_panel(health_stage(cases, deaths), exposure, mobility)
