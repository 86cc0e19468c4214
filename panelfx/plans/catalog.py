"""Registered queries: every operator of the library applied to the panel the driver's
tables define (see ``sources.testpanel``). Each entry takes (spark, sf_dir) and returns
a DataFrame over the whole tables; queries whose plan forks write the fork to the shared
folder when they are built. ``panelfx.plans.oracle`` holds the matching SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import (agg_expr, clean_label, finite_or_null, index_to_date, iso_week, member_flag, null_if_negative,
                         parse_date, ratio, relative_time, sign_flag, threshold_flag, zero_over_zero)
from ..operators import aggregate, cohort, columns, events, fe, infer, merge, panel, pools, quality, segments, series, synth, tables
from ..session import materialize, shared_path
from ..sources import testpanel as tp
from ..sources.io import export_csv, read_csv, read_stage, read_table, read_wide_csv, read_wide_csv_long, write_stage

SPEC = tp.SPEC
Query = Callable[[SparkSession, str], DataFrame]


def _cumulative(p: DataFrame) -> DataFrame:
    """Test input for de-cumulation: the running total of `delta` per unit."""
    return p.withColumn("cum", F.sum("delta").over(SPEC.frame(Window.unboundedPreceding, 0)))


# ---------------------------------------------------------------- step 1: series

def q_test_panel(spark, sf):
    return tp.order_panel(spark, sf)


def q_smoothed_ratio(spark, sf):
    """Flagship: 7-row rolling numerator over the 7-row rolling denominator lagged 7 rows,
    and over the same-row denominator, per unit (W8 -> W6 -> N1)."""
    p = tp.order_panel(spark, sf, with_dose=False).select("u", "t", "k", "n")
    p = p.withColumns({"k7": series.rolling_sum_expr(SPEC, "k", 7), "n7": series.rolling_sum_expr(SPEC, "n", 7)})
    p = p.withColumn("n7_lag7", series.lag_expr(SPEC, "n7", 7))
    return p.select("u", "t", "k7", "n7", "n7_lag7",
                    ratio("k7", "n7_lag7", "ieee").alias("ratio7_lag7"),
                    ratio("k7", "n7", "ieee").alias("ratio7_same"))


def q_customer_smoothed_ratio(spark, sf):
    """The flagship chain with the customer as unit (units grow with the data): 4-row
    rolling sums, the denominator lagged 4 rows, IEEE ratios."""
    spec = tp.PanelSpec("c", "t")
    p = tp.customer_panel(spark, sf).select("c", "t", "k", "n")
    p = p.withColumns({"k4": series.rolling_sum_expr(spec, "k", 4), "n4": series.rolling_sum_expr(spec, "n", 4)})
    p = p.withColumn("n4_lag4", series.lag_expr(spec, "n4", 4))
    return p.select("c", "t", "k4", "n4", "n4_lag4", ratio("k4", "n4_lag4", "ieee").alias("ratio4_lag4"),
                    ratio("k4", "n4", "ieee").alias("ratio4_same"))


def q_decumulate_total(spark, sf):
    p = _cumulative(tp.order_panel(spark, sf, with_dose=False).select("u", "t", "delta"))
    return p.select("u", "t", "cum", series.decumulate_expr(SPEC, "cum", "total").alias("step"))


def q_decumulate_zero(spark, sf):
    p = _cumulative(tp.order_panel(spark, sf, with_dose=False).select("u", "t", "delta"))
    return p.select("u", "t", "cum", series.decumulate_expr(SPEC, "cum", "zero").alias("step"))


def q_repair_negative(spark, sf):
    """W3/W4/W5 on the first-row-zero step series."""
    p = tp.order_panel(spark, sf, with_dose=False).select("u", "t", "delta")
    p = _cumulative(p).withColumn("step", series.decumulate_expr(SPEC, "cum", "zero"))
    return p.select("u", "t", "step",
                    series.repair_negative_expr(SPEC, "step", "null").alias("step_null"),
                    series.repair_negative_expr(SPEC, "step", "previous").alias("step_prev"),
                    series.repair_negative_expr(SPEC, "step", "last_good").alias("step_last_good"))


def q_lagged_measures(spark, sf):
    """W6 (lag 14) and W7 (mean of lags 14..8)."""
    p = tp.order_panel(spark, sf, with_dose=False).select("u", "t", "n", "k")
    return p.select("u", "t", "n",
                    series.lag_expr(SPEC, "n", 14).alias("n_lag14"),
                    series.lagged_mean_expr(SPEC, "n", 14, 8).alias("n_avg8_14"),
                    series.lagged_mean_expr(SPEC, "k", 14, 8).alias("k_avg8_14"))


def q_rolling_sums(spark, sf):
    """W8 with 7 and 14 rows."""
    p = tp.order_panel(spark, sf, with_dose=False).select("u", "t", "n", "k")
    return p.select("u", "t",
                    series.rolling_sum_expr(SPEC, "n", 7).alias("n_roll7"),
                    series.rolling_sum_expr(SPEC, "k", 7).alias("k_roll7"),
                    series.rolling_sum_expr(SPEC, "n", 14).alias("n_roll14"),
                    series.rolling_sum_expr(SPEC, "k", 14).alias("k_roll14"))


def _completed(spark, sf, fill=True) -> DataFrame:
    """Balanced panel: every unit x every week of the span; absent weeks get n = k = mob = 0
    (or stay null with fill=False); the exposure is computed after completion."""
    p = materialize(tp.order_panel(spark, sf, with_dose=False).drop("wk"))   # fork: read by grid and join
    c = panel.complete_panel(p, SPEC, fill={"n": 0, "k": 0, "mob": 0.0} if fill else None, flag="added")
    c = c.withColumn("wk", index_to_date("t", tp.WEEK0, 0, 7))
    return c.withColumn("dose", tp.dose_expr()) if fill else c


def _smoothed(spark, sf) -> DataFrame:
    p = tp.order_panel(spark, sf, with_dose=False).select("u", "t", "k", "n")
    p = p.withColumns({"k7": series.rolling_sum_expr(SPEC, "k", 7), "n7": series.rolling_sum_expr(SPEC, "n", 7)})
    return p.withColumn("n7_lag7", series.lag_expr(SPEC, "n7", 7))


def _labelled(spark, sf) -> DataFrame:
    return tp.order_panel(spark, sf, with_dose=False).join(tp.unit_labels(spark, sf), "u")


EXPOSURES = {"p50": 50.0, "p70": 70.0, "p90": 90.0}


SEGMENT = 2_000


def q_long_unit_series(spark, sf):
    """W1, W3-W9 where one unit holds a third of all rows: order by order, every third order
    belongs to unit 0 and the others to their customers; the rows are cut into time segments."""
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"])
    spec = tp.PanelSpec("u", "t")
    cents = F.round(F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint") % 1000 - 400
    o = o.select(F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey")).cast("bigint").alias("u"), F.col("o_orderkey").cast("bigint").alias("t"),
                 cents.alias("x"), F.when(F.col("o_orderkey") % 7 != 0, cents).alias("y"))
    rows = segments.numbered(o, spec, SEGMENT)
    rows = segments.running_total(rows, spec, "y", "cum")
    rows = segments.repair_last_good(rows, spec, "x", "x_last_good")
    rows = segments.over_segments(rows, spec, lambda s: {
        "step": series.decumulate_expr(s, "x", "total"), "x_null": series.repair_negative_expr(s, "x", "null"),
        "x_prev": series.repair_negative_expr(s, "x", "previous"), "x_lag14": series.lag_expr(s, "x", 14),
        "x_avg8_14": series.lagged_mean_expr(s, "x", 14, 8), "y_roll7": series.rolling_sum_expr(s, "y", 7),
        "y_filled": series.interpolate_gap_expr(s, "y")}, back=14, ahead=1, length=SEGMENT)
    return rows.drop("__pos", "__seg")


# ---------------------------------------------------------------- step 2: panel

def _wide(p: DataFrame) -> DataFrame:
    """One column per week of the calendar (v5, v6, ...): its weeks are the only thing listed."""
    p = materialize(p.withColumn("day", F.col("t") + 5).select("u", "day", "cum"))   # fork: calendar + pivot
    days = sorted(r[0] for r in p.select("day").distinct().collect())
    return panel.long_to_wide(p, ["u"], "day", "cum", "v", days)


def q_wide_to_long(spark, sf):
    """P1 + P2: running totals pivoted to one column per week (v5, v6, ...), then back to long."""
    p = _cumulative(tp.order_panel(spark, sf, with_dose=False).select("u", "t", "delta"))
    wide = _wide(p)
    long = panel.wide_to_long(wide, ["u"], "v", "day", "cum")
    return long.withColumn("wk", index_to_date("day", tp.WEEK0, -5, 7))


def q_panel_duplicates(spark, sf):
    """(customer, order week) keys that are not unique in orders."""
    o = read_table(spark, sf, "orders", ["o_custkey", "o_orderdate"])
    o = o.select("o_custkey", F.to_date(F.date_trunc("week", "o_orderdate")).alias("wk"))
    return panel.duplicate_keys(o, ["o_custkey", "wk"])


REGION_CODES = {"AFRICA": "AF", "AMERICA": "AM", "ASIA": "AS", "EUROPE": "EU"}


def q_recode_names(spark, sf):
    """Value recode map applied to the unit's region name (unmapped values kept)."""
    p = _labelled(spark, sf).select("u", "t", "r_name")
    return panel.recode(p, "r_name", REGION_CODES, out="region")


def q_parse_dates(spark, sf):
    """yyyyMMdd numbers back to dates."""
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    d8 = (F.year("o_orderdate") * 10000 + F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate")).cast("bigint")
    return o.select("o_orderkey", d8.alias("d8")).withColumn("parsed", parse_date("d8"))


def q_iso_weeks(spark, sf):
    """P10 + P11: ISO week number of the week start and time relative to week 200."""
    p = tp.order_panel(spark, sf, with_dose=False)
    return p.select("u", "t", iso_week("wk").alias("week"), relative_time("t", 200).alias("rel"))


def q_exposure_flags(spark, sf):
    """P12 + P13: exposure threshold flags and the negative-step flag."""
    p = tp.order_panel(spark, sf)
    return p.select("u", "t", *[threshold_flag("dose", c).alias(n) for n, c in EXPOSURES.items()],
                    sign_flag("delta").alias("neg"))


def q_unit_labels(spark, sf):
    """P14 + P9 + P16: cleaned label, eligibility flag and dense unit id."""
    p = materialize(_labelled(spark, sf).select("u", "t", "n_name", "r_name"))   # fork: key table + join back
    p = p.withColumns({
        "label": clean_label("n_name", "r_name", remove=[" ", "_"]),
        "eligible": member_flag("n_name", tp.EXPOSED_NATIONS, F.col("r_name") == tp.EXPOSED_REGION),
    })
    return panel.dense_unit_id(p, ["n_name", "r_name"], out="id")


def q_melt_outcomes(spark, sf):
    """Two ratio measures as (outcome, Y) rows, scaled by 1000."""
    p = _smoothed(spark, sf).select("u", "t", ratio("k7", "n7_lag7", "ieee").alias("ratio7_lag7"),
                                    ratio("k7", "n7", "ieee").alias("ratio7_same"))
    return panel.melt_outcomes(p, ["u", "t"], ["ratio7_lag7", "ratio7_same"], scale=1000.0)


def q_complete_panel(spark, sf):
    """Balanced unit x week panel, zero-filled, exposure after completion."""
    return _completed(spark, sf).select("u", "t", "wk", "n", "k", "delta", "mob", "dose", "added")


def q_customer_complete_panel(spark, sf):
    """W10 with customers as units: every customer x every week of the span, zero-filled."""
    p = materialize(tp.customer_panel(spark, sf).select("c", "t", "n", "k"))
    return panel.complete_panel(p, tp.PanelSpec("c", "t"), fill={"n": 0, "k": 0}, flag="added")


def q_interpolate_gaps(spark, sf):
    """Single missing weeks filled with the mean of their neighbours."""
    c = _completed(spark, sf, fill=False).select("u", "t", "n", "mob")
    return series.interpolate_gap(c, SPEC, ["n", "mob"])


def q_fill_missing_dates(spark, sf):
    """Added calendar rows have no week date; take it from the date built from t."""
    p = materialize(tp.order_panel(spark, sf, with_dose=False))
    c = panel.complete_panel(p, SPEC).select("u", "t", "wk").withColumn("wk_from_t", index_to_date("t", tp.WEEK0, 0, 7))
    return series.fill_from(c, "wk", "wk_from_t")


def q_panel_gaps(spark, sf):
    """Unit-weeks absent from the panel."""
    p = materialize(tp.order_panel(spark, sf, with_dose=False).select("u", "t"))   # fork: calendar + anti join
    return panel.panel_gaps(p, SPEC)


def q_panel_gap_runs(spark, sf):
    """Y1 as runs: customers' absent weeks, one row for each gap however long."""
    p = materialize(tp.customer_panel(spark, sf).select("c", "t"))
    return panel.gap_runs(p, CUSTOMER)


# ---------------------------------------------------------------- step 3: merges

def _two_sources(spark, sf):
    left = tp.order_panel(spark, sf, with_dose=False).select("u", "t", "wk", "n", "k", "delta", "mob")
    right = tp.shipment_panel(spark, sf).select("u", "t", "wk", "n", "k", "mob")
    return left, right      # both are aggregates by (u, t): unique, no key check needed


def q_merge_all(spark, sf):
    """Full 1:1 merge, left value wins on shared columns, with a merge indicator."""
    l_, r_ = _two_sources(spark, sf)
    return merge.merge_one_to_one(l_, r_, ["u", "t"], "all", indicator="_merge", validate=False)


def q_merge_match(spark, sf):
    """Matched rows only."""
    l_, r_ = _two_sources(spark, sf)
    return merge.merge_one_to_one(l_, r_, ["u", "t"], "match", validate=False)


def q_merge_left(spark, sf):
    """Left rows with their matches."""
    l_, r_ = _two_sources(spark, sf)
    return merge.merge_one_to_one(l_, r_, ["u", "t"], "left", indicator="_merge", validate=False)


def q_merge_null_keys(spark, sf):
    """J1 with keys that are null: every unit of the first region has none (of several such units
    the lowest stays, a key must be unique); both sides' null keys match, and the keys' uniqueness
    is asserted in the plan."""
    def nulled(p):
        first = (F.col("u") % 5 == 0)
        return p.filter(~first | (F.col("u") == 0)).withColumn("u", F.when(~first, F.col("u")))
    l_, r_ = _two_sources(spark, sf)
    return merge.merge_one_to_one(nulled(l_), nulled(r_), ["u", "t"], "all", indicator="_merge")


def q_natural_join_totals(spark, sf):
    """Unit totals joined back on the shared key."""
    p = materialize(tp.order_panel(spark, sf, with_dose=False).select("u", "t", "k"))   # fork: totals + join
    tot = aggregate.unit_totals(p, SPEC, "k", "total_k")
    return merge.natural_left_join(p, tot)


def q_null_safe_join(spark, sf):
    """Natural left join where null keys match null keys."""
    c = _completed(spark, sf, fill=False).select("u", "t", "delta")
    counts = c.groupBy("u", "delta").agg(F.count(F.lit(1)).alias("n_weeks"))
    return merge.natural_left_join(c, counts, null_safe=True)


def q_drop_bad_units(spark, sf):
    """J7 + D2: drop every unit that still has a negative step after the 'previous' repair."""
    p = _cumulative(tp.order_panel(spark, sf, with_dose=False).select("u", "t", "delta"))
    p = p.withColumn("step", series.decumulate_expr(SPEC, "cum", "zero"))
    p = materialize(p.withColumn("step", series.repair_negative_expr(SPEC, "step", "previous")))  # fork
    bad = quality.units_failing(p, SPEC, F.col("step") < 0)
    return merge.drop_matching(p, bad, ["u"])


def q_append_sources(spark, sf):
    """Rows of both sources stacked by name; columns missing on one side are null."""
    l_, r_ = _two_sources(spark, sf)
    return merge.append(l_.withColumn("source", F.lit("orders")), r_.withColumn("source", F.lit("lines")))


def q_distinct_values(spark, sf):
    """Distinct (nation, segment) pairs of the customers."""
    c = read_table(spark, sf, "customer", ["c_nationkey", "c_mktsegment"])
    return merge.distinct_values(c, ["c_nationkey", "c_mktsegment"])


# ---------------------------------------------------------------- step 4: aggregates

def _steps_null(spark, sf):
    p = _cumulative(tp.order_panel(spark, sf, with_dose=False).select("u", "t", "delta"))
    p = p.withColumn("step", series.decumulate_expr(SPEC, "cum", "zero"))
    return p.withColumn("step_null", series.repair_negative_expr(SPEC, "step", "null"))


def q_strict_unit_sum(spark, sf):
    """G1: NA-propagating unit sum next to the skipping sum."""
    p = _steps_null(spark, sf)
    return p.groupBy("u").agg(agg_expr("sum", "step_null", strict=True).alias("total_strict"),
                              agg_expr("sum", "step_null", strict=False).alias("total_skip"))


def q_weekly_resample(spark, sf):
    """Daily unit series down-sampled to weeks (strict means)."""
    d = tp.order_panel_daily(spark, sf).withColumn("delta_pos", null_if_negative("delta"))
    return aggregate.resample(d, tp.PanelSpec("u", "day"), F.to_date(F.date_trunc("week", "day")),
                              {"n_mean": "n", "k_mean": "k", "delta_mean": "delta_pos"},
                              how="mean", strict=True, period_name="wk")


def q_unit_means(spark, sf):
    """Per-unit means (missing values skipped)."""
    p = _completed(spark, sf)
    return aggregate.group_agg(p, ["u"], {"dose_mean": ("mean", "dose"), "n_mean": ("mean", "n"),
                                          "delta_mean": ("mean", "delta")})


def q_unit_mean_attached(spark, sf):
    """The unit's mean exposure on every row."""
    p = _completed(spark, sf).select("u", "t", "dose")
    return aggregate.group_stat(p, ["u"], "dose", "mean", out="dose_unit_mean")


def q_negative_summary(spark, sf):
    """Summary statistics of the negative steps, per unit."""
    p = _steps_null(spark, sf)
    s = aggregate.summarize(p, "step", where=F.col("step") < 0, by=["u"])
    return s.withColumn("sd", F.round("sd", 10)).withColumn("mean", F.round("mean", 10))


def q_units_by_total(spark, sf):
    """keep units whose total numerator reaches 200."""
    p = tp.order_panel(spark, sf, with_dose=False).select("u", "t", "k", "n")
    return aggregate.filter_units_by_total(p, SPEC, "k", 200, out="total_k")


# ---------------------------------------------------------------- step 5: quality

def _ratios(spark, sf, completed: DataFrame | None = None):
    """Smoothed ratios on the zero-filled balanced panel (zero denominators occur there)."""
    c = completed if completed is not None else _completed(spark, sf)
    p = c.select("u", "t", "k", "n", "delta")
    p = p.withColumns({"k7": series.rolling_sum_expr(SPEC, "k", 7), "n7": series.rolling_sum_expr(SPEC, "n", 7)})
    p = p.withColumn("n7_lag7", series.lag_expr(SPEC, "n7", 7))
    return p.select("u", "t", "k", "delta", "k7", "n7", "n7_lag7",
                    ratio("k7", "n7_lag7", "ieee").alias("r_lag"), ratio("k7", "n7", "ieee").alias("r_same"))


def q_ratio_rules(spark, sf):
    """N1 (null mode) + N2 + N3 on the panel's ratios."""
    return _ratios(spark, sf).select("u", "t",
                    ratio("k", "delta", "null").alias("r_null"),
                    null_if_negative(ratio("k", "delta", "null")).alias("r_nonneg"),
                    zero_over_zero("k7", "n7_lag7", "r_lag").alias("r_zz"),
                    finite_or_null(zero_over_zero("k7", "n7_lag7", "r_lag")).alias("r_finite"))


def q_negative_rows(spark, sf):
    """Rows with a negative step."""
    p = _steps_null(spark, sf).select("u", "t", "cum", "step")
    return quality.report_negative(p, ["step"])


def q_outlier_units(spark, sf):
    """D3: units with a ratio above 1 (+Inf counts, NaN does not)."""
    return quality.units_failing(_ratios(spark, sf), SPEC, quality.outlier_cond(["r_lag", "r_same"]))


def q_nan_units(spark, sf):
    """D4 before the 0/0 rule."""
    return quality.units_failing(_ratios(spark, sf), SPEC, quality.nan_cond(["r_lag", "r_same"]))


def q_nan_units_after(spark, sf):
    """D4 after the 0/0 rule."""
    p = _ratios(spark, sf)
    p = p.withColumns({"r_lag": zero_over_zero("k7", "n7_lag7", "r_lag"),
                       "r_same": zero_over_zero("k7", "n7", "r_same")})
    return quality.units_failing(p, SPEC, quality.nan_cond(["r_lag", "r_same"]))


def q_inf_units(spark, sf):
    """Units with an infinite ratio."""
    return quality.units_failing(_ratios(spark, sf), SPEC, quality.inf_cond(["r_lag", "r_same"]))


CUSTOMER = tp.PanelSpec("c", "t")


def _customer_ratios(spark, sf) -> DataFrame:
    """Ratios of 4-week sums with customers as units on their zero-filled weeks: most weeks
    have no order, so 0/0 and x/0 both occur."""
    p = q_customer_complete_panel(spark, sf).select("c", "t", "n", "k")
    p = p.withColumns({"k4": series.rolling_sum_expr(CUSTOMER, "k", 4), "n4": series.rolling_sum_expr(CUSTOMER, "n", 4)})
    p = p.withColumn("n4_lag4", series.lag_expr(CUSTOMER, "n4", 4))
    return p.select("c", "t", "k", "n", "k4", "n4", "n4_lag4",
                    ratio("k4", "n4_lag4", "ieee").alias("r_lag"), ratio("k4", "n4", "ieee").alias("r_same"))


def _customer_zero_rule(p: DataFrame) -> DataFrame:
    return p.withColumns({"r_lag": zero_over_zero("k4", "n4_lag4", "r_lag"), "r_same": zero_over_zero("k4", "n4", "r_same")})


def q_customer_ratio_rules(spark, sf):
    """N1 (IEEE and null mode), N3 and the finite rule where denominators are zero."""
    p = _customer_ratios(spark, sf)
    zz = zero_over_zero("k4", "n4_lag4", "r_lag")
    return p.select("c", "t", "r_lag", "r_same", ratio("k4", "n4_lag4", "null").alias("r_null"), zz.alias("r_zz"),
                    finite_or_null(zz).alias("r_finite"))


def q_customer_outlier_units(spark, sf):
    """D3 with customers as units: ratios above 1, +Inf among them, NaN not."""
    return quality.units_failing(_customer_ratios(spark, sf), CUSTOMER, quality.outlier_cond(["r_lag", "r_same"]))


def q_customer_nan_units(spark, sf):
    """D4 with customers as units, before the 0/0 rule."""
    return quality.units_failing(_customer_ratios(spark, sf), CUSTOMER, quality.nan_cond(["r_lag", "r_same"]))


def q_customer_nan_rows_after(spark, sf):
    """D4 after the 0/0 rule: rows that were NaN are 0 now, and no NaN is left."""
    p = _customer_ratios(spark, sf)
    was = quality.nan_cond(["r_lag", "r_same"])
    p = _customer_zero_rule(p.withColumn("was_nan", F.coalesce(was, F.lit(False))))
    return p.groupBy("c").agg(F.sum(F.col("was_nan").cast("long")).alias("n_was_nan"),
                              F.sum(F.coalesce(was, F.lit(False)).cast("long")).alias("n_nan"))


def q_customer_inf_units(spark, sf):
    """D5 with customers as units: x/0 in the lagged ratio."""
    return quality.units_failing(_customer_ratios(spark, sf), CUSTOMER, quality.inf_cond(["r_lag", "r_same"]))


# ---------------------------------------------------------------- step 6: events

def _flagged(spark, sf):
    c = _completed(spark, sf)
    return c.withColumns({n: threshold_flag("dose", cut) for n, cut in EXPOSURES.items()})


def q_first_exposure(spark, sf):
    """First week each unit crosses each exposure cut."""
    return events.first_exposure(_flagged(spark, sf), SPEC, {n: n for n in EXPOSURES})


def q_mark_first_exposure(spark, sf):
    """First-exposure markers on the panel rows."""
    p = _flagged(spark, sf).select("u", "t", "dose", *EXPOSURES)
    return events.mark_first_exposure(p, SPEC, {n: n for n in EXPOSURES})


def q_first_rows(spark, sf):
    """Each unit's first row."""
    return events.first_rows(tp.order_panel(spark, sf, with_dose=False).select("u", "t", "n"), SPEC)


# ---------------------------------------------------------------- step 7: cohorts

OUTCOMES = ["r_lag", "r_same"]
COHORT_RULES = cohort.CohortRules(covariate="mob", outcome_limit=1.0, max_share=0.01)


def _cohort_panel(spark, sf):
    """Balanced panel with two smoothed ratio outcomes, the covariate and exposure flags,
    cut to weeks >= 20 after the rolling windows (so every window is complete)."""
    c = _completed(spark, sf).select("u", "t", "k", "n", "mob", "dose")
    c = c.withColumns({"k7": series.rolling_sum_expr(SPEC, "k", 7), "n7": series.rolling_sum_expr(SPEC, "n", 7)})
    c = c.withColumn("n7_lag7", series.lag_expr(SPEC, "n7", 7))
    c = c.select("u", "t", "mob", *[threshold_flag("dose", cut).alias(n) for n, cut in EXPOSURES.items()],
                 finite_or_null(ratio("k7", "n7_lag7", "ieee")).alias("r_lag"),
                 finite_or_null(ratio("k7", "n7", "ieee")).alias("r_same"))
    return c.filter(F.col("t") >= 20)


def _treated_units(spark, sf):
    lab = tp.unit_labels(spark, sf)
    return lab.filter(member_flag("n_name", tp.EXPOSED_NATIONS, F.col("r_name") == tp.EXPOSED_REGION) == "Yes")


def _cohorts(spark, sf):
    grid = cohort.cohort_grid(_treated_units(spark, sf), "u", list(EXPOSURES), OUTCOMES)
    cp = materialize(_cohort_panel(spark, sf))                  # fork: unit facts, events and rows
    return materialize(cohort.build_cohorts(cp, SPEC, grid, OUTCOMES, {n: n for n in EXPOSURES},
                                            COHORT_RULES))      # fork: synth, inference and FE


def q_cohorts(spark, sf):
    """E5 (+J9, W12, E3, E4, F4-F6, G5, P16): every (exposure, treated unit, outcome) cohort."""
    return _cohorts(spark, sf)


def q_cohorts_with_missing(spark, sf):
    """F4 where it fires: every third unit's covariate is missing in its weeks without
    orders, so that unit leaves its cohorts, treated or donor."""
    raw = _completed(spark, sf, fill=False).select("u", "t", F.col("mob").alias("raw_mob"))
    cp = _cohort_panel(spark, sf).join(raw, ["u", "t"])
    cp = cp.withColumn("mob", F.when(F.col("u") % 3 == 0, F.col("raw_mob")).otherwise(F.col("mob"))).drop("raw_mob")
    grid = cohort.cohort_grid(_treated_units(spark, sf), "u", list(EXPOSURES), OUTCOMES)
    coh = cohort.build_cohorts(materialize(cp), SPEC, grid, OUTCOMES, {n: n for n in EXPOSURES},
                               cohort.CohortRules(covariate="mob", outcome_limit=None, max_share=None))
    return coh.select("exposure", "treated_unit", "outcome", "u", "t", "Y", "mob", "treated", "event_time", "day_one", "id")


def q_cohort_ledger(spark, sf):
    """E5's rules on a panel where each of them fires: outcomes missing for every seventh unit's weeks
    without orders, covariates for every third's, rows for every eleventh's; cohorts that lost their
    treated unit are reported too."""
    c = _completed(spark, sf, fill=False).select("u", "t", "n", "mob", "added")
    c = c.withColumns({"n0": F.coalesce("n", F.lit(0)), "mob0": F.coalesce("mob", F.lit(0.0))})
    y = F.when((F.col("u") % 7 != 1) | (F.col("added") == 0), F.col("n0") / (F.col("n0") + 1.0))
    mob = F.when((F.col("u") % 3 != 0) | (F.col("added") == 0), F.col("mob0"))
    p = c.filter((F.col("u") % 11 != 2) | (F.col("added") == 0)).withColumns({"y": y, "w": y * 0.95, "m": mob, "dose": tp.dose_expr(n="n0")})
    p = materialize(p.select("u", "t", "y", "w", "m", *[threshold_flag("dose", cut).alias(n) for n, cut in EXPOSURES.items()]))
    rules = cohort.CohortRules(covariate="m", outcome_limit=0.85, max_share=0.01)
    grid = cohort.cohort_grid(_treated_units(spark, sf), "u", list(EXPOSURES), ["y", "w"])
    return cohort.cohort_ledger(p, SPEC, grid, ["y", "w"], {n: n for n in EXPOSURES}, rules)


def q_cohort_bounds(spark, sf):
    """First time and event time per cohort."""
    return cohort.cohort_bounds(_cohorts(spark, sf))


SUPPLIER_RULES = cohort.CohortRules(covariate="mob", outcome_limit=None, max_share=0.01)


def _supplier_grid(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Suppliers as units (their number grows with the tables) and the grid of their cohorts: months
    zero-filled, outcome = share of returned lines, exposure = five months for every fiftieth one."""
    p = materialize(tp.supplier_panel(spark, sf))
    p = panel.complete_panel(p, SPEC, fill={"n": 0, "k": 0, "mob": 0.0})
    hit = (F.col("u") % 50 == 3) & (F.col("t") >= 40 + F.col("u") % 7) & (F.col("t") < 45 + F.col("u") % 7)
    r = ratio("k", "n", "ieee")
    p = p.withColumns({"r_ret": F.when(F.col("n") == 0, F.lit(0.0)).otherwise(r), "hot": F.when(hit, 1).otherwise(0)})
    p = materialize(p.select("u", "t", "mob", "r_ret", "hot"))
    return p, cohort.cohort_grid(p.filter(F.col("u") % 50 == 3).select("u"), "u", ["hot"], ["r_ret"])


def _supplier_cohorts(spark, sf) -> DataFrame:
    """Their cohorts, each with its own copy of all unexposed suppliers."""
    p, grid = _supplier_grid(spark, sf)
    return cohort.build_cohorts(p, SPEC, grid, ["r_ret"], {"hot": "hot"}, SUPPLIER_RULES)


def _supplier_pools(spark, sf) -> pools.Pools:
    """Their cohorts with the unexposed suppliers stored once."""
    p, grid = _supplier_grid(spark, sf)
    return pools.build_pools(p, SPEC, grid, ["r_ret"], {"hot": "hot"}, SUPPLIER_RULES)


def q_supplier_cohorts(spark, sf):
    """E5 with suppliers as units."""
    return _supplier_cohorts(spark, sf).select("exposure", "treated_unit", "outcome", "u", "t", "Y", "mob", "X", "treated", "event_time", "id")


def q_supplier_fe_att(spark, sf):
    """Y11 with suppliers as units: every cohort has all unexposed suppliers as donors, stored once."""
    att = pools.fe_att(_supplier_pools(spark, sf))
    return _rounded(att.withColumn("beta", F.col("beta") * 1e6), ["att", "beta"])


def q_supplier_placebo_pvalues(spark, sf):
    """Y7 with suppliers as units: every treated effect ranked among one shared order of placebos."""
    return pools.placebo_pvalues(_supplier_pools(spark, sf))


def _ragged_suppliers(spark, sf, split: int | None = None) -> pools.Pools:
    """Cohorts of suppliers without zero fill: only the months a supplier shipped in, the donors stored
    once. With `split`, donors with an even number are seen before that month only, odd ones from it on."""
    p = tp.supplier_panel(spark, sf)
    hit = (F.col("u") % 50 == 3) & (F.col("t") >= 40 + F.col("u") % 7) & (F.col("t") < 45 + F.col("u") % 7)
    p = materialize(p.select("u", "t", "mob", ratio("k", "n", "ieee").alias("r_ret"), F.when(hit, 1).otherwise(0).alias("hot")))
    grid = cohort.cohort_grid(p.filter(F.col("u") % 50 == 3).select("u"), "u", ["hot"], ["r_ret"])
    rules = cohort.CohortRules(drop_gaps=False, covariate="mob", outcome_limit=None, max_share=0.01)
    found = pools.build_pools(p, SPEC, grid, ["r_ret"], {"hot": "hot"}, rules, keep_lost=True)
    if split is None:
        return found
    early = F.col("t") < split
    return pools.Pools(found.rows.filter((early & (F.col("u") % 2 == 0)) | (~early & (F.col("u") % 2 == 1))), found.cohorts, found.treated)


def q_supplier_fe_split(spark, sf):
    """Y11 on an unbalanced panel with a planted model: outcome = unit and time effects, two per
    million of the covariate, and a known effect; donors change at month 43, so whether an effect
    is identified hangs on the treated supplier's own months."""
    found = _ragged_suppliers(spark, sf, split=43)
    y = lambda u: (F.col(u) % 17) * 0.25 + (F.col("t") % 11) * 0.5 + F.col("x") * 2e-6
    lead = F.col("t") - F.col("event_time")
    effect = F.when(F.col("t") >= F.col("event_time"), 0.1 * (1 + lead % 5)).otherwise(0.0)
    planted = pools.Pools(found.rows.withColumn("Y", y("u")), found.cohorts, found.treated.withColumn("Y", y("treated_unit") + effect))
    att = pools.att_of(pools.fe_ragged(planted))
    return _rounded(att.withColumn("beta", F.col("beta") * 1e6), ["att", "beta"], 5)


def q_supplier_fe_certificates(spark, sf):
    """Y11's solver on the real outcome without zero fill: per cohort the connected parts, and that
    it took rounds and its residuals are free of time effects."""
    c = pools.fe_ragged(_ragged_suppliers(spark, sf, split=43))
    return c.select(*cohort.COHORT_KEYS, "parts", (F.col("rounds") > 0).alias("iterated"),
                    ((F.col("residual_y") < 1e-10) & (F.col("residual_x") < 1e-10)).alias("certified"))


# ---------------------------------------------------------------- step 8: inference (donor-mean weights)

def _rounded(df: DataFrame, cols, digits: int = 9) -> DataFrame:
    """Report precision for values built from floating sums over units (the engines add
    in different orders; the last bits are not meaningful)."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _uniform_gaps(spark, sf):
    return infer.synth_series(_cohorts(spark, sf))


def q_synth_gaps_uniform(spark, sf):
    """Y5 with donor-mean weights: synthetic series and gap of every fit."""
    return _rounded(_uniform_gaps(spark, sf), ["synth", "gap"])


def q_rmspe_uniform(spark, sf):
    """pre/post RMSPE and ratio per fit."""
    return _rounded(infer.rmspe(_uniform_gaps(spark, sf)), ["pre_rmspe", "post_rmspe", "rmspe_ratio"])


def q_placebo_pvalues_uniform(spark, sf):
    """One-sided standardized placebo p-values per cohort and post-event time."""
    return infer.placebo_pvalues(_uniform_gaps(spark, sf))


def q_effect_ci_uniform(spark, sf):
    """Y8 + Y9 + P17: effect table with p-value based 90 % intervals."""
    g = _uniform_gaps(spark, sf)
    e = infer.effect_table(g, infer.placebo_pvalues(g))
    return _rounded(e, ["effect2", "tdiff", "zval", "se", "upper_ci", "lower_ci", "ci_low", "ci_high"])


# ---------------------------------------------------------------- step 9: synthetic control

def _predictors(spark, sf, coh: DataFrame | None = None):
    return synth.predictors(coh if coh is not None else _cohorts(spark, sf), cols=["Y", "mob"])


def q_predictors(spark, sf):
    """Y2: scaled predictors (outcome and covariate at every pre-period time incl. the event)."""
    return _rounded(_predictors(spark, sf).drop("sd"), ["x_scaled"], 6)


def _weights(spark, sf, coh: DataFrame | None = None):
    return synth.synth_weights(_predictors(spark, sf, coh), placebo=True)


def q_synth_weights(spark, sf):
    """Y3 + Y4: simplex-constrained donor weights for the treated unit and every placebo."""
    return _weights(spark, sf)


def _weight_checks(pred: DataFrame, w: DataFrame) -> DataFrame:
    """One row per fit: whether its weights are a point of the simplex on allowed donors, carry a
    proof of optimality, and fit the predictors no worse than equal weights do -- all from the weights
    table and the predictors alone."""
    keys = cohort.COHORT_KEYS
    x = pred.select(*keys, "u", "treated", "var", "t", "x_scaled")
    # loss of the solved weights, from the weights table and the predictors alone
    own = x.select(*keys, F.col("u").alias("fit_unit"), "var", "t", F.col("x_scaled").alias("x_fit"))
    fit = (w.join(x.select(*keys, F.col("u").alias("donor"), "var", "t", "x_scaled"), [*keys, "donor"])
           .groupBy(*keys, "fit_unit", "var", "t").agg(F.sum(F.col("weight") * F.col("x_scaled")).alias("x_syn")))
    sq = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    loss = fit.join(own, [*keys, "fit_unit", "var", "t"]).groupBy(*keys, "fit_unit").agg(F.sum(sq("x_fit", "x_syn")).alias("loss"))
    # loss of equal weights, from per-predictor sums
    sums = x.groupBy(*keys, "var", "t").agg(F.sum("x_scaled").alias("s"), F.count(F.lit(1)).alias("n"),
                                            F.sum(F.col("treated") * F.col("x_scaled")).alias("s_tr"), F.sum("treated").alias("n_tr"))
    even = x.join(sums, [*keys, "var", "t"]).withColumns({
        "others": F.col("s") - F.col("s_tr") - F.when(F.col("treated") == 1, 0).otherwise(F.col("x_scaled")),
        "m": F.col("n") - F.col("n_tr") - F.when(F.col("treated") == 1, 0).otherwise(1)})
    even = even.withColumn("x_even", F.try_divide("others", "m")).groupBy(*keys, F.col("u").alias("fit_unit")).agg(
        F.sum(sq("x_scaled", "x_even")).alias("even_loss"))
    per = w.groupBy(*keys, "fit_unit").agg(F.sum("weight").alias("total"), F.min("weight").alias("least"), F.max("gap").alias("gap"),
                                           F.max((F.col("donor") == F.col("fit_unit")).cast("int")).alias("self"),
                                           F.max((F.col("donor") == F.col("treated_unit")).cast("int")).alias("tr"))
    out = per.join(loss, [*keys, "fit_unit"]).join(even, [*keys, "fit_unit"])
    return out.select(*keys, "fit_unit", (F.abs(F.col("total") - 1) < 1e-9).alias("sums_to_one"), (F.col("least") > 0).alias("positive"),
                      ((F.col("self") == 0) & (F.col("tr") == 0)).alias("donors_allowed"), (F.col("gap") <= 1e-8).alias("optimal"),
                      (F.col("loss") <= F.col("even_loss") * (1 + 1e-9)).alias("no_worse_than_equal"))


def q_synth_weight_checks(spark, sf):
    """Y3 + Y4, one row per fit: its weights are a point of the simplex, carry a proof of
    optimality, and fit the predictors no worse than equal weights do."""
    pred = materialize(_predictors(spark, sf))
    return _weight_checks(pred, materialize(synth.synth_weights(pred, placebo=True)))


def _pool_weight_checks(found: pools.Pools, pred: DataFrame, w: DataFrame) -> DataFrame:
    """`_weight_checks` of the treated units' fits on pools: the donors' predictors from the pool's rows."""
    keys = cohort.COHORT_KEYS
    x = found.rows.withColumnRenamed("x", "c").unpivot([*pools.POOL, "u", "t"], ["Y", "c"], "var", "x")
    mix = w.join(x.withColumnRenamed("u", "donor"), [*pools.POOL, "donor"]).groupBy(*keys, "var", "t").agg(
        F.sum(F.col("weight") * F.col("x")).alias("x_syn"))
    apart = lambda c: (F.col("x_scaled") - c / F.col("sd")) * (F.col("x_scaled") - c / F.col("sd"))
    loss = pred.join(mix, [*keys, "var", "t"]).groupBy(*keys).agg(
        F.sum(apart(F.col("x_syn"))).alias("loss"), F.sum(apart(F.try_divide("s", "m"))).alias("even_loss"))
    per = w.groupBy(*keys, "fit_unit").agg(F.sum("weight").alias("total"), F.min("weight").alias("least"), F.max("gap").alias("gap"),
                                           F.max((F.col("donor") == F.col("treated_unit")).cast("int")).alias("tr"))
    return per.join(loss, keys).select(
        *keys, "fit_unit", (F.abs(F.col("total") - 1) < 1e-9).alias("sums_to_one"), (F.col("least") > 0).alias("positive"),
        (F.col("tr") == 0).alias("donors_allowed"), (F.col("gap") <= 1e-8).alias("optimal"),
        (F.col("loss") <= F.col("even_loss") * (1 + 1e-9)).alias("no_worse_than_equal"))


def q_supplier_synth_checks(spark, sf):
    """Y3 with suppliers as units, by column generation: every unexposed supplier is a donor, stored and
    priced once for all cohorts; their number grows with the tables."""
    found = _supplier_pools(spark, sf)
    pred = materialize(synth.pool_predictors(found), "pool_predictors")
    donors, fits = synth.pool_vectors(found, pred)
    return _pool_weight_checks(found, pred, materialize(columns.synth_weights_pools(donors, fits)))


PLANTED_MIX = {1: 0.5, 2: 0.3, 4: 0.2}


def _planted(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Cohorts whose treated units are, outcome and covariate, a known mix of three donors before their
    event and ten plus the lead above it after, and the solver's weights of every fit."""
    c = _completed(spark, sf).select("u", "t", "dose", (F.col("n") / (F.col("n") + 1.0)).alias("y"), (F.col("mob") / 1e6).alias("x"))
    c = materialize(c.withColumn("p50", threshold_flag("dose", 50.0)))
    share = F.element_at(F.create_map(*[F.lit(v) for kv in PLANTED_MIX.items() for v in kv]), F.col("u"))
    mix = c.filter(F.col("u").isin(*PLANTED_MIX)).groupBy("t").agg(F.sum(share * F.col("y")).alias("my"), F.sum(share * F.col("x")).alias("mx"))
    event = c.filter("p50 = 1").groupBy("u").agg(F.min("t").alias("t0"))
    c = c.join(mix, "t").join(event, "u", "left")
    effect = F.when(F.col("t") >= F.col("t0"), 10.0 + F.col("t") - F.col("t0")).otherwise(0.0)
    own = F.col("u") % 5 == 3
    c = c.select("u", "t", "p50", F.when(own, F.col("my") + effect).otherwise(F.col("y")).alias("y"), F.when(own, F.col("mx")).otherwise(F.col("x")).alias("mob"))
    grid = cohort.cohort_grid(_treated_units(spark, sf), "u", ["p50"], ["y"])
    coh = materialize(cohort.build_cohorts(materialize(c), SPEC, grid, ["y"], {"p50": "p50"},
                                           cohort.CohortRules(covariate="mob", outcome_limit=None, max_share=0.01)))
    pred = synth.predictors(coh, cols=["Y", "mob"], include_event=False)
    return coh, materialize(synth.synth_weights(pred, placebo=True))


def q_planted_donor_weights(spark, sf):
    """Y3 + Y10 + F7 where the answer is known: the mix comes back as the donor table."""
    lab = tp.unit_labels(spark, sf).select("u", clean_label("n_name", "r_name", remove=[" ", "_"]).alias("label"))
    w = infer.donor_weights(_planted(spark, sf)[1], lab, "label").select(*cohort.COHORT_KEYS, "donor", "label", F.round("weight", 7).alias("weight"))
    return w.filter("weight > 0")


def q_planted_synth_effects(spark, sf):
    """Y5 + Y7-Y9 + P17 on the solver's weights where the answer is known: the synthetic series is
    the mix, the effect what was planted, and no placebo comes near it."""
    coh, w = _planted(spark, sf)
    g = materialize(infer.synth_series(coh, weights=w))
    e = infer.effect_table(g, infer.placebo_pvalues(g, standardize=False))
    return _rounded(e, ["effect1", "effect2", "tdiff", "zval", "se", "upper_ci", "lower_ci", "ci_low", "ci_high"], 6)


def q_donor_weights(spark, sf):
    """Positive donor weights of the treated fit, with the donor's label."""
    lab = tp.unit_labels(spark, sf).select("u", clean_label("n_name", "r_name", remove=[" ", "_"]).alias("label"))
    return infer.donor_weights(_weights(spark, sf), lab, "label")


def q_synth_effects(spark, sf):
    """Y5-Y9 with the solved weights: effect table with placebo p-values and CIs."""
    coh = _cohorts(spark, sf)
    w = materialize(_weights(spark, sf, coh))     # fork: the gaps feed RMSPE, p-values and the table
    g = infer.synth_series(coh, weights=w)
    return infer.effect_table(g, infer.placebo_pvalues(g))


# ---------------------------------------------------------------- step 10: fixed-effect counterfactual

def q_fe_att(spark, sf):
    """Two-way FE counterfactual (covariate mob) fitted on untreated rows; average
    effect on the treated unit by time since its event, per cohort."""
    coh = _cohorts(spark, sf).withColumn(
        "treat", events.treated_flag(F.col("u"), F.col("treated_unit"), F.col("t"), F.col("event_time")))
    att = fe.att_by_time(fe.fe_counterfactual(coh, y="Y", cov="mob", treat="treat"))
    return _rounded(att.withColumn("beta", F.col("beta") * 1e6), ["att", "beta"])   # beta per million of the covariate


# ---------------------------------------------------------------- step 11: plot tables

def _effect_series(spark, sf):
    e = q_effect_ci_uniform(spark, sf)
    return tables.series_table(e, ["exposure", "outcome", "treated_unit"], "lead", ["upper_ci", "tdiff", "lower_ci"])


def q_effect_series_table(spark, sf):
    """CI band and estimate per facet as tidy (facet, x, series, y) rows."""
    return _effect_series(spark, sf)


def q_figure_axes(spark, sf):
    """Shared y range of each combined figure (one figure per exposure and outcome)."""
    return tables.axis_bounds(_effect_series(spark, sf), ["exposure", "outcome"])


def q_treated_vs_synthetic(spark, sf):
    """Treated and synthetic series of every cohort as tidy rows (donor-mean weights)."""
    g = _uniform_gaps(spark, sf).filter(F.col("treated_fit") == 1)
    return tables.series_table(_rounded(g, ["synth"]), ["exposure", "outcome", "treated_unit"], "t", ["Y", "synth"])


def q_eligible_series(spark, sf):
    """The smoothed ratio series of the eligible units."""
    p = _smoothed(spark, sf).join(_treated_units(spark, sf).select("u", "n_name"), "u")
    p = p.select("n_name", "t", finite_or_null(ratio("k7", "n7_lag7", "ieee")).alias("r_lag"),
                 finite_or_null(ratio("k7", "n7", "ieee")).alias("r_same"))
    return tables.series_table(p, ["n_name"], "t", ["r_lag", "r_same"])


# ---------------------------------------------------------------- step 12: stages and the rest

def q_insert_listed_weeks(spark, sf):
    """W10 (listed times) + W9: three listed weeks inserted where a customer lacks them, then
    filled from the neighbouring rows."""
    p = materialize(tp.customer_panel(spark, sf).select("c", "t", "n"))
    return series.interpolate_gap(panel.insert_times(p, CUSTOMER, LISTED_WEEKS), CUSTOMER, ["n"])


LISTED_WEEKS = [100, 150, 151]


def q_drop_sentinel(spark, sf):
    """F2 + P6 + P3: rows of unit 0 dropped, listed columns kept where present, renamed."""
    p = tp.order_panel(spark, sf, with_dose=False)
    p = panel.select_present(p.filter((F.col("u") != 0) | F.col("u").isNull()), ["u", "t", "n", "not_there", "k"])
    return p.withColumnsRenamed({"n": "orders", "k": "finished"})


def q_stage_round_trip(spark, sf):
    """The panel written as a stage partitioned by unit, and opened again."""
    root = shared_path(spark, "stages")
    write_stage(tp.order_panel(spark, sf, with_dose=False).select("u", "t", "n", "k"), root, "panel", ["u"])
    return read_stage(spark, root, "panel").select("u", "t", "n", "k")


def q_csv_round_trip(spark, sf):
    """S2 + S7: the shipment panel exported as CSV and read with an explicit schema."""
    p = tp.shipment_panel(spark, sf).select("u", "t", "n", "k")
    return read_csv(spark, export_csv(p, shared_path(spark, "csv")), "u int, t int, n bigint, k bigint")


def q_wide_csv_round_trip(spark, sf):
    """S1 + P1: the wide running totals exported as CSV, read back and made long."""
    p = _cumulative(tp.order_panel(spark, sf, with_dose=False).select("u", "t", "delta"))
    path = export_csv(_wide(p), shared_path(spark, "csv"))
    wide = read_wide_csv(spark, path, T.StructType([T.StructField("u", T.IntegerType())]))
    return panel.wide_to_long(wide, ["u"], "v", "day", "cum")


def q_wide_csv_long(spark, sf):
    """S1 + P1 in one pass: the same wide file, its lines split once and exploded by position."""
    p = _cumulative(tp.order_panel(spark, sf, with_dose=False).select("u", "t", "delta"))
    path = export_csv(_wide(p), shared_path(spark, "csv"))
    return read_wide_csv_long(spark, path, T.StructType([T.StructField("u", T.IntegerType())]), "v", "day", "cum")


QUERIES: dict[str, Query] = {
    "test_panel": q_test_panel,
    "smoothed_ratio": q_smoothed_ratio,
    "customer_smoothed_ratio": q_customer_smoothed_ratio,
    "decumulate_total": q_decumulate_total,
    "decumulate_zero": q_decumulate_zero,
    "repair_negative": q_repair_negative,
    "lagged_measures": q_lagged_measures,
    "rolling_sums": q_rolling_sums,
    "wide_to_long": q_wide_to_long,
    "panel_duplicates": q_panel_duplicates,
    "recode_names": q_recode_names,
    "parse_dates": q_parse_dates,
    "iso_weeks": q_iso_weeks,
    "exposure_flags": q_exposure_flags,
    "unit_labels": q_unit_labels,
    "melt_outcomes": q_melt_outcomes,
    "complete_panel": q_complete_panel,
    "customer_complete_panel": q_customer_complete_panel,
    "interpolate_gaps": q_interpolate_gaps,
    "fill_missing_dates": q_fill_missing_dates,
    "panel_gaps": q_panel_gaps,
    "panel_gap_runs": q_panel_gap_runs,
    "long_unit_series": q_long_unit_series,
    "merge_all": q_merge_all,
    "merge_match": q_merge_match,
    "merge_left": q_merge_left,
    "merge_null_keys": q_merge_null_keys,
    "natural_join_totals": q_natural_join_totals,
    "null_safe_join": q_null_safe_join,
    "drop_bad_units": q_drop_bad_units,
    "append_sources": q_append_sources,
    "distinct_values": q_distinct_values,
    "strict_unit_sum": q_strict_unit_sum,
    "weekly_resample": q_weekly_resample,
    "unit_means": q_unit_means,
    "unit_mean_attached": q_unit_mean_attached,
    "negative_summary": q_negative_summary,
    "units_by_total": q_units_by_total,
    "ratio_rules": q_ratio_rules,
    "negative_rows": q_negative_rows,
    "outlier_units": q_outlier_units,
    "nan_units": q_nan_units,
    "nan_units_after": q_nan_units_after,
    "inf_units": q_inf_units,
    "customer_ratio_rules": q_customer_ratio_rules,
    "customer_outlier_units": q_customer_outlier_units,
    "customer_nan_units": q_customer_nan_units,
    "customer_nan_rows_after": q_customer_nan_rows_after,
    "customer_inf_units": q_customer_inf_units,
    "first_exposure": q_first_exposure,
    "mark_first_exposure": q_mark_first_exposure,
    "first_rows": q_first_rows,
    "cohorts": q_cohorts,
    "cohorts_with_missing": q_cohorts_with_missing,
    "supplier_cohorts": q_supplier_cohorts,
    "supplier_fe_att": q_supplier_fe_att,
    "supplier_placebo_pvalues": q_supplier_placebo_pvalues,
    "supplier_fe_split": q_supplier_fe_split,
    "supplier_fe_certificates": q_supplier_fe_certificates,
    "cohort_bounds": q_cohort_bounds,
    "cohort_ledger": q_cohort_ledger,
    "synth_gaps_uniform": q_synth_gaps_uniform,
    "rmspe_uniform": q_rmspe_uniform,
    "placebo_pvalues_uniform": q_placebo_pvalues_uniform,
    "effect_ci_uniform": q_effect_ci_uniform,
    "predictors": q_predictors,
    "synth_weights": q_synth_weights,
    "synth_weight_checks": q_synth_weight_checks,
    "supplier_synth_checks": q_supplier_synth_checks,
    "planted_donor_weights": q_planted_donor_weights,
    "planted_synth_effects": q_planted_synth_effects,
    "donor_weights": q_donor_weights,
    "synth_effects": q_synth_effects,
    "fe_att": q_fe_att,
    "effect_series_table": q_effect_series_table,
    "figure_axes": q_figure_axes,
    "treated_vs_synthetic": q_treated_vs_synthetic,
    "eligible_series": q_eligible_series,
    "insert_listed_weeks": q_insert_listed_weeks,
    "drop_sentinel": q_drop_sentinel,
    "stage_round_trip": q_stage_round_trip,
    "csv_round_trip": q_csv_round_trip,
    "wide_csv_round_trip": q_wide_csv_round_trip,
    "wide_csv_long": q_wide_csv_long,
}
