"""Column generation against the packed solver and known mixes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelfx.operators import columns, synth

KEYS = ["exposure", "treated_unit", "outcome"]


def cohort(spark, donors, times, seed=0, name="e", names=int):
    """One cohort of `donors` random series; the treated unit is a mix of three of them plus noise."""
    rng = np.random.default_rng(seed)
    Y = rng.normal(size=(donors, times))
    treated = 0.5 * Y[2] + 0.3 * Y[5] + 0.2 * Y[donors - 1] + (rng.normal(size=times) * 0.5 if seed else 0)
    rows = [(name, names(0), "y", names(u), t, float(v), int(u == 0), times - 1, 0)
            for u in range(donors + 1) for t, v in enumerate(treated if u == 0 else Y[u - 1])]
    return spark.createDataFrame(pd.DataFrame(rows, columns=[*KEYS, "u", "t", "Y", "treated", "event_time", "day_one"]))


def same(a, b):
    a, b = (x.toPandas().set_index([*KEYS, "fit_unit", "donor"])["weight"] for x in (a, b))
    both = pd.concat([a, b], axis=1).fillna(0.0)
    return float(np.abs(both.iloc[:, 0] - both.iloc[:, 1]).max())


def test_equals_the_packed_solver(spark):
    """Every placebo of three cohorts, over many small blocks, wider and narrower than the predictors."""
    coh = cohort(spark, 14, 30, 1).unionByName(cohort(spark, 60, 9, 2, "f")).unionByName(cohort(spark, 6, 5, 3, "g").filter("u < 3"))
    pred = synth.predictors(coh, cols=["Y"])
    got = columns.synth_weights_columns(pred, columns=4, block_bytes=8 * 30 * 7)
    want = synth.synth_weights(pred)
    g = got.toPandas()
    # a fit that lies inside the donors' hull has many solutions: the loss is unique then, not the weights
    outside = F.col("fit_rmse") > 1e-6
    assert same(got.filter(outside), want.filter(outside)) < 1e-8
    assert want.filter(outside).select("exposure", "fit_unit").distinct().count() > 30
    assert (g["weight"] > 0).all() and g["gap"].max() <= 1e-8 and not (g["donor"] == g["fit_unit"]).any() and not (g["donor"] == 0).any()
    assert np.allclose(g.groupby([*KEYS, "fit_unit"])["weight"].sum(), 1.0, atol=1e-12)
    r = want.toPandas().groupby([*KEYS, "fit_unit"])["fit_rmse"].first()
    assert np.allclose(g.groupby([*KEYS, "fit_unit"])["fit_rmse"].first(), r, atol=1e-8)


def test_recovers_a_mix_of_string_units(spark):
    pred = synth.predictors(cohort(spark, 40, 25, names=lambda u: f"unit-{u}"), cols=["Y"])
    w = columns.synth_weights_columns(pred, placebo=False).toPandas().set_index("donor")["weight"]
    assert abs(w["unit-3"] - 0.5) < 1e-8 and abs(w["unit-6"] - 0.3) < 1e-8 and abs(w["unit-40"] - 0.2) < 1e-8


def test_refuses_ragged_predictors_and_unfinished_rounds(spark):
    ragged = synth.predictors(cohort(spark, 11, 12, 4).filter("NOT (u = 4 AND t = 3)"), cols=["Y"])
    with pytest.raises(ValueError, match="different predictor sets"):
        columns.synth_weights_columns(ragged)
    left = columns.synth_weights_columns(ragged, on_gap="drop").toPandas()
    assert 4 not in set(left["donor"]) | set(left["fit_unit"]) and left["fit_unit"].nunique() == 11
    whole = synth.predictors(cohort(spark, 30, 20, 5), cols=["Y"])
    with pytest.raises(RuntimeError, match="has not ended"):
        columns.synth_weights_columns(whole, placebo=False, columns=1, max_rounds=2)
