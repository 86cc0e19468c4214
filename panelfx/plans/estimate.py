"""Stage 3 -- estimate: cohorts for the whole (exposure x treated county x outcome) grid,
synthetic-control weights with every donor as a placebo, placebo p-values and
p-value-based intervals, donor weight tables, and the fixed-effect counterfactual.

Every step runs for all cohorts in one job; the cohort table is the fork that the
synthetic-control, inference and fixed-effect branches read, so it is materialized
once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohort, events, fe, infer, synth
from ..session import materialize
from ..spec import PanelSpec

# Fixed values of the analysis.
EXPOSURE_FLAGS = {"heavy70": "p_heavy70", "heavy50": "p_heavy50", "heavy90": "p_heavy90", "medium70": "p_medium70"}
FLAG_RENAMES = {"heavy_smoke_p50": "p_heavy50", "heavy_smoke_p70": "p_heavy70", "heavy_smoke_p90": "p_heavy90",
                "medium_smoke_p70": "p_medium70"}
OUTCOMES = ["CFR14_lag7", "CFR14_same_day"]
COVARIATE = "populationstayingathome"
Y_SCALE = 1000.0


def estimate(daily: DataFrame, exposures: Sequence[str] = tuple(EXPOSURE_FLAGS), outcomes: Sequence[str] = tuple(OUTCOMES),
             covariate: str = COVARIATE, placebo: bool = True, y_scale: float = Y_SCALE,
             rules: cohort.CohortRules | None = None, event_shift: int = 0) -> dict[str, DataFrame]:
    """`daily` is the output of ``smooth.daily_panel`` (unit id `id`, time `time`,
    `eligible` Yes/No, the four exposure flags). Returns cohorts, weights, donor weight
    tables, the effect table with CIs, and the fixed-effect ATT by relative time.

    Event times come from the panel's first-exposure markers (`first_smoke_<e>` = 1 on
    the row whose `smoke_<e>_day1` holds the time), which were found before the date
    cut: a county first exposed before the cut has no marker row left and no event.
    Without marker columns they are recomputed from the flags."""
    d = daily.withColumnsRenamed({k: v for k, v in FLAG_RENAMES.items() if k in daily.columns})
    d = d.withColumn("label", F.replace(F.replace(F.replace(F.concat(F.replace("countyname", F.lit(" "), F.lit("")),
                                                                        "state"), F.lit("County"), F.lit("")),
                                                  F.lit("."), F.lit("")), F.lit("'"), F.lit("")))
    d = d.withColumnRenamed("id", "unit_id")
    spec = PanelSpec("unit_id", "time")
    d = materialize(d, "daily")                   # read by the grid, the events, the unit facts and the rows
    treated = d.filter(F.col("eligible") == "Yes").select("unit_id")
    grid = cohort.cohort_grid(treated, "unit_id", list(exposures), list(outcomes))
    rules = rules or cohort.CohortRules(covariate=covariate, outcome_limit=1.0, max_share=0.01)
    flags = {e: EXPOSURE_FLAGS[e] for e in exposures}
    marks = [e for e in exposures if f"first_smoke_{e}" in d.columns and f"smoke_{e}_day1" in d.columns]
    first_times = None
    if len(marks) == len(exposures):
        first_times = (d.select("unit_id", F.explode(F.array(*[
            F.struct(F.lit(e).alias("definition"),
                     F.when(F.col(f"first_smoke_{e}") == 1, F.col(f"smoke_{e}_day1")).alias("event_time"))
            for e in exposures])).alias("__e"))
            .select("unit_id", "__e.definition", "__e.event_time")
            .filter(F.col("event_time").isNotNull())
            .groupBy("unit_id", "definition").agg(F.min("event_time").alias("event_time")))
    coh = cohort.build_cohorts(d, spec, grid, list(outcomes), flags, rules, events=first_times, carry=["label"],
                               event_shift=event_shift)
    coh = materialize(coh.withColumn("Y", F.col("Y") * F.lit(y_scale)).withColumnRenamed("time", "t"))
    ckeys = cohort.COHORT_KEYS
    pred = synth.predictors(coh, cols=["Y", covariate], unit="unit_id")
    pred = pred.withColumnRenamed("unit_id", "u")
    weights = materialize(synth.synth_weights(pred, unit="u", placebo=placebo))
    rows = coh.withColumnRenamed("unit_id", "u")
    gaps = infer.synth_series(rows, unit="u", weights=weights)
    effect = infer.effect_table(gaps, infer.placebo_pvalues(gaps))
    labels = rows.select("u", "label").distinct()
    donor_table = infer.donor_weights(weights, labels, "label").withColumnsRenamed({"label": "CountyState",
                                                                                   "weight": "Weight"})
    fe_in = rows.withColumn("treat", events.treated_flag(F.col("u"), F.col("treated_unit"), F.col("t"),
                                                         F.col("event_time")))
    att = fe.att_by_time(fe.fe_counterfactual(fe_in, y="Y", cov=covariate, treat="treat", unit="u", t="t",
                                              keys=ckeys))
    return {"cohorts": coh, "weights": weights, "donor_weights": donor_table, "effects": effect, "fe_att": att}
