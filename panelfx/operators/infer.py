"""Effect series and placebo inference on cohorts.

Input: the long cohort table of ``cohort.build_cohorts`` (cohort keys, unit, t, Y,
treated, event_time). Every unit of a cohort is a *fit*: the treated unit is the
real fit, every donor is a placebo fit (its donors: all other units except the
treated one).

* ``synth_series`` with a weights table (cohort, fit_unit, donor, weight) joins the
  sparse weights to the donors' rows and sums per (cohort, fit, t); without weights it
  uses the donor mean, computed from per-(cohort, t) sums -- no unit pairs at all.
* Placebo p-values compare the treated fit with the placebo fits of the same cohort
  and time: a keyed join with one treated row per key, so its output is linear in
  the placebo rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.inference import ci_columns
from .cohort import COHORT_KEYS

GAP_COLS = [*COHORT_KEYS, "fit_unit", "t", "Y", "synth", "gap", "treated_fit", "event_time"]


def synth_series(cohorts: DataFrame, unit: str = "u", t: str = "t", weights: DataFrame | None = None) -> DataFrame:
    """Synthetic series and gap for every fit of every cohort.

    weights: (exposure, treated_unit, outcome, fit_unit, donor, weight) or None for
    the donor mean. Columns: cohort keys, fit_unit, t, Y (the fit's own value), synth,
    gap = Y - synth, treated_fit (1 for the treated unit's fit), event_time.
    """
    rows = cohorts.select(*COHORT_KEYS, F.col(unit).alias("fit_unit"), t, "Y", "treated", "event_time")
    if weights is None:
        # per (cohort, t) sums, combined map-side and joined back: no task holds a time's units
        sums = rows.groupBy(*COHORT_KEYS, t).agg(
            F.sum("Y").alias("__s"), F.count(F.lit(1)).alias("__n"), F.sum("treated").alias("__trn"),
            F.coalesce(F.sum(F.when(F.col("treated") == 1, F.col("Y"))), F.lit(0.0)).alias("__trs"))
        rows = rows.join(sums, [*COHORT_KEYS, t])
        s, n, tr_sum, tr_n = F.col("__s"), F.col("__n"), F.col("__trs"), F.col("__trn")
        synth = F.when(F.col("treated") == 1, F.try_divide(s - F.col("Y"), (n - 1).cast("double"))) \
                 .otherwise(F.try_divide(s - F.col("Y") - tr_sum, (n - 1 - tr_n).cast("double")))
        out = rows.withColumn("synth", synth)
    else:
        donors = cohorts.select(*COHORT_KEYS, F.col(unit).alias("donor"), t, F.col("Y").alias("__yd"))
        sy = (weights.join(donors, [*COHORT_KEYS, "donor"])
              .groupBy(*COHORT_KEYS, "fit_unit", t)
              .agg(F.sum(F.col("weight") * F.col("__yd")).alias("synth")))
        fits = weights.select(*COHORT_KEYS, "fit_unit").distinct()
        out = rows.join(fits, [*COHORT_KEYS, "fit_unit"]).join(sy, [*COHORT_KEYS, "fit_unit", t], "left")
    return out.select(*COHORT_KEYS, "fit_unit", t, "Y", "synth", (F.col("Y") - F.col("synth")).alias("gap"),
                      F.col("treated").alias("treated_fit"), "event_time")


def rmspe(gaps: DataFrame, t: str = "t") -> DataFrame:
    """Pre- and post-event root mean squared gap per fit, and their ratio."""
    g2 = F.col("gap") * F.col("gap")
    pre = F.col(t) < F.col("event_time")
    post = F.col(t) >= F.col("event_time")
    r = gaps.groupBy(*COHORT_KEYS, "fit_unit", "treated_fit").agg(
        F.sqrt(F.avg(F.when(pre, g2))).alias("pre_rmspe"),
        F.sqrt(F.avg(F.when(post, g2))).alias("post_rmspe"))
    return r.withColumn("rmspe_ratio", F.try_divide(F.col("post_rmspe"), F.col("pre_rmspe")))


def placebo_pvalues(gaps: DataFrame, t: str = "t", standardize: bool = True,
                    rmspe_table: DataFrame | None = None) -> DataFrame:
    """One-sided placebo p-value per cohort and post-event time.

    The treated effect e (gap, divided by the fit's pre-event RMSPE when
    `standardize`) is compared with every placebo's effect at the same time: p is the
    share of placebos at least as extreme in e's direction (>= e when e >= 0, <= e
    otherwise). The denominator counts placebos only, so p can be 0.
    """
    g = gaps.filter(F.col(t) >= F.col("event_time"))
    if standardize:
        r = rmspe_table if rmspe_table is not None else rmspe(gaps, t)
        g = g.join(r.select(*COHORT_KEYS, "fit_unit", "pre_rmspe"), [*COHORT_KEYS, "fit_unit"])
        g = g.withColumn("__e", F.try_divide(F.col("gap"), F.col("pre_rmspe")))
    else:
        g = g.withColumn("__e", F.col("gap"))
    tr = g.filter(F.col("treated_fit") == 1).select(*COHORT_KEYS, t, "event_time", F.col("__e").alias("__e_tr"))
    pl = g.filter(F.col("treated_fit") == 0).select(*COHORT_KEYS, t, F.col("__e").alias("__e_pl"))
    hit = F.when(F.col("__e_tr") >= 0, F.col("__e_pl") >= F.col("__e_tr")).otherwise(F.col("__e_pl") <= F.col("__e_tr"))
    j = tr.join(pl, [*COHORT_KEYS, t], "left")
    return (j.groupBy(*COHORT_KEYS, t, "event_time")
            .agg(F.avg(F.when(F.col("__e_pl").isNotNull() & F.col("__e_tr").isNotNull(), hit.cast("double")))
                 .alias("pval"),
                 F.count("__e_pl").alias("n_placebos"))
            .withColumn("lead", F.col(t) - F.col("event_time"))
            .drop("event_time"))


def effect_table(gaps: DataFrame, pvals: DataFrame, t: str = "t", z_crit: float = 1.645) -> DataFrame:
    """Y8 + Y9 + P17: the treated fit from its event on, keyed by time (not by
    position): effect1 = observed, effect2 = synthetic, tdiff = effect1 - effect2, the
    placebo p-value, the p-value-based CI columns, and ti = 1, 2, ... per cohort."""
    tr = gaps.filter((F.col("treated_fit") == 1) & (F.col(t) >= F.col("event_time")))
    e = (tr.select(*COHORT_KEYS, t, (F.col(t) - F.col("event_time")).alias("lead"),
                   F.col("Y").alias("effect1"), F.col("synth").alias("effect2"), F.col("gap").alias("tdiff"))
         .join(pvals.select(*COHORT_KEYS, t, "pval"), [*COHORT_KEYS, t], "left"))
    e = e.withColumns(ci_columns("tdiff", "pval", z_crit))
    return e.withColumn("ti", event_index(t))


def event_index(t: str = "t", keys: Sequence[str] = tuple(COHORT_KEYS)):
    """1, 2, ... in time order within each cohort (window per cohort: one
    cohort's post-event rows)."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(t))


def donor_weights(weights: DataFrame, labels: DataFrame | None = None, unit_label: str | None = None,
                  treated_only: bool = True) -> DataFrame:
    """Positive donor weights of the treated fit (or of every fit), with an
    optional donor label. Columns: cohort keys, [fit_unit,] donor, [label,] weight."""
    w = weights.filter(F.col("weight") > 0)
    if treated_only:
        w = w.filter(F.col("fit_unit") == F.col("treated_unit")).drop("fit_unit")
    if labels is not None and unit_label is not None:
        key = labels.columns[0]
        w = w.join(labels.select(F.col(key).alias("donor"), F.col(unit_label).alias("label")), "donor", "left")
    return w
