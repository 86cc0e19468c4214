"""End-to-end stages on small files in the source layout: wide cumulative CSVs, a long
exposure CSV with one day missing, a mobility CSV; compile -> smooth -> estimate."""

import datetime as dt
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelfx.plans import compile as comp
from panelfx.plans import estimate, smooth
from panelfx.sources.io import export_csv, read_stage, write_stage

DAYS = [comp.FIRST_DAY + dt.timedelta(days=i) for i in range((comp.LAST_DAY - comp.FIRST_DAY).days + 1)]
COUNTIES = [(i + 1, n, "CA", 6) for i, n in enumerate(smooth.ELIGIBLE_UNITS)] + \
    [(10 + i, f"Donor{i} County", st, 30 + i) for i, st in enumerate(["NY", "TX", "WA", "OR", "NV", "AZ", "UT"])]


def make_files():
    rng = np.random.default_rng(1)
    d = tempfile.mkdtemp(prefix="panelfx-stage-", dir="/tmp")
    cases, deaths, expo, mob = [], [], [], []
    for fips, name, st, sfips in COUNTIES + [(0, "Statewide Unallocated", "CA", 6)]:
        dc = rng.poisson(80, len(DAYS)).astype(int)
        dd = rng.poisson(3, len(DAYS)).astype(int)
        cc, cd = np.cumsum(dc), np.cumsum(dd)
        cd[100] = cd[99] - 5                                     # a downward correction: negative daily value
        cases.append([fips, name, st, sfips, *cc])
        deaths.append([fips, name, st, sfips, *cd])
        for i, day in enumerate(DAYS):
            hot = st == "CA" and dt.date(2020, 9, 1) + dt.timedelta(days=fips) <= day < dt.date(2020, 9, 8)
            h = 95.0 if hot else float(rng.uniform(0, 5))
            if day != dt.date(2020, 7, 8):                       # the exposure file lacks this day
                expo.append([fips, int(day.strftime("%Y%m%d")), 1.0, 1.0, 1.0, 10.0, h / 2, h])
            mob.append(["County", day.strftime("%Y/%m/%d"), st, name, float(1000 + rng.normal(0, 30)), 5000.0])
    cols = ["countyfips", "countyname", "state", "statefips"] + [f"v{5 + i}" for i in range(len(DAYS))]
    paths = {k: os.path.join(d, f"{k}.csv") for k in ["cases", "deaths", "exposure", "mobility"]}
    pd.DataFrame(cases, columns=cols).to_csv(paths["cases"], index=False)
    pd.DataFrame(deaths, columns=cols).to_csv(paths["deaths"], index=False)
    pd.DataFrame(expo, columns=["geoid", "dates", "light", "medium", "heavy", "light_pct", "medium_pct",
                                "heavy_pct"]).to_csv(paths["exposure"], index=False)
    pd.DataFrame(mob, columns=["level", "date", "statepostalcode", "countyname", "populationstayingathome",
                               "populationnotstayingathome"]).to_csv(paths["mobility"], index=False)
    paths["dir"] = d
    return paths


@pytest.fixture(scope="module")
def files():
    return make_files()


def test_compile_smooth_estimate(spark, files):
    panel = comp.compile_from_files(spark, files["deaths"], files["cases"], files["exposure"], files["mobility"])
    root = os.path.join(files["dir"], "stages")
    write_stage(panel, root, "compiled")
    p = read_stage(spark, root, "compiled")
    n_days = len(DAYS)
    assert p.count() == len(COUNTIES) * n_days                   # fips 0 dropped, every day kept
    assert p.filter(F.col("date") == F.lit(dt.date(2020, 7, 8))).filter(F.col("heavy_pct").isNull()).count() == 0
    first = p.filter(F.col("day") == 5).select("death", "total_d").collect()
    assert all(r["death"] == r["total_d"] for r in first)        # first day keeps its total
    assert p.filter(F.col("death") < 0).count() == len(COUNTIES)  # reported, not repaired, at stage 1

    sm = smooth.smoothed(smooth.prepare(p)).persist()
    neg = smooth.negative_reports(smooth.prepare(p))
    assert neg["death"].count() == len(COUNTIES)
    export_csv(neg["death"], os.path.join(files["dir"], "neg_death"))
    daily = smooth.daily_panel(sm)
    assert daily.filter(F.col("date") < F.lit(smooth.ANALYSIS_START)).count() == 0
    ev = daily.filter(F.col("first_smoke_heavy70") == 1).select("countyname").distinct().count()
    assert ev == 6
    weekly = smooth.weekly_panel(sm)
    assert weekly.select("countyname", "state", "week").distinct().count() == weekly.count()

    out = estimate.estimate(daily, exposures=["heavy70"], outcomes=["CFR14_same_day"])
    w = out["weights"].toPandas()
    assert np.allclose(w.groupby(["treated_unit", "fit_unit"])["weight"].sum(), 1.0, atol=1e-9)
    assert out["effects"].count() > 0 and out["fe_att"].count() > 0
    dw = out["donor_weights"].toPandas()
    assert set(dw.columns) >= {"CountyState", "Weight"} and (dw["Weight"] > 0).all()


def test_stage_one_reports_and_unsmoothed_panels(spark, files):
    from panelfx.sources.io import read_wide_csv
    wide = [read_wide_csv(spark, files[k], comp.ID_SCHEMA) for k in ("deaths", "cases")]
    reports = comp.negative_reports(*wide)
    summary, rows = reports["death"]
    assert rows.count() == len(COUNTIES) + 1 and summary.first()["obs"] == len(COUNTIES) + 1   # one correction each
    assert reports["cases"][1].count() == 0 and reports["CFR_14dys"][1].count() >= len(COUNTIES)
    root = os.path.join(files["dir"], "unsmoothed")
    panel = comp.compile_from_files(spark, files["deaths"], files["cases"], files["exposure"], files["mobility"])
    write_stage(smooth.prepare(panel), root, "prepared")
    out = smooth.unsmoothed_panels(read_stage(spark, root, "prepared"))
    for name, unit_time in (("weekly", "week"), ("daily", "day")):
        p = out[name]
        assert p.select("countyname", "state", unit_time).distinct().count() == p.count()
        marks = p.filter("first_smoke = 1")
        assert marks.count() == marks.filter("time = smoke_week1 AND smoke_bin = 1").count()
        assert p.filter(F.col("week") < smooth.MIN_WEEK).count() == 0
    assert out["daily"].filter("first_smoke = 1").count() == 6


def test_compile_reads_every_file_once(spark, files):
    """The key checks of the three merges run inside the plan: no job runs while it is built, and
    each CSV is scanned by one node."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plan only")
    panel = comp.compile_from_files(spark, files["deaths"], files["cases"], files["exposure"], files["mobility"])
    lines = panel._jdf.queryExecution().executedPlan().toString()
    heads = len(tracker.getJobIdsForGroup("building"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert heads <= 2                                    # the header lines of the two wide files
    # insert_times appends rows for the listed day, so the exposure file is also read for its counties
    scans = {k: lines.count(f"{k}.csv") for k in ("deaths", "cases", "mobility")}
    assert scans == {"deaths": 1, "cases": 1, "mobility": 1}
