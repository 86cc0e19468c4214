"""Estimator invariants SQL cannot express: simplex weights, placebo inference, CI
formula, and the fixed-effect counterfactual on noiseless data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelfx.functions import ci_columns
from panelfx.operators import fe, infer, synth
from panelfx.operators.synth import simplex_least_squares


def test_ci_from_pvalue_golden(spark):
    df = spark.createDataFrame([(-2.0, 0.05), (3.0, 0.0)], "est double, p double")
    rows = df.select(*[c.alias(n) for n, c in ci_columns("est", "p").items()]).collect()
    exp = [(1.95664, 1.02216, -3.68145, -0.31855), (3.92179, -0.76496, 4.25835, 1.74165)]
    for r, (z, se, up, lo) in zip(rows, exp):
        assert abs(r["zval"] - z) < 1e-5 and abs(r["se"] - se) < 1e-5
        assert abs(r["upper_ci"] - up) < 1e-5 and abs(r["lower_ci"] - lo) < 1e-5
        assert r["ci_low"] <= r["ci_high"]


def test_ci_null_when_p_is_one(spark):
    r = spark.createDataFrame([(1.0, 1.0)], "est double, p double").select(
        *[c.alias(n) for n, c in ci_columns("est", "p").items()]).first()
    assert r["zval"] < 0 and r["ci_low"] is None and r["ci_high"] is None


def test_simplex_kernel_exact_mix():
    rng = np.random.default_rng(7)
    X = rng.normal(size=(30, 11))
    w_true = np.zeros(11)
    w_true[[1, 4, 9]] = [0.5, 0.3, 0.2]
    b = X @ w_true
    w, _ = simplex_least_squares(X, b)
    assert np.max(np.abs(w - w_true)) < 1e-10


def test_simplex_kernel_beats_uniform():
    rng = np.random.default_rng(3)
    X, b = rng.normal(size=(8, 20)), rng.normal(size=8)
    w, _ = simplex_least_squares(X, b)
    assert abs(w.sum() - 1) < 1e-12 and w.min() >= 0
    u = np.full(20, 1 / 20)
    assert np.sum((X @ w - b) ** 2) <= np.sum((X @ u - b) ** 2) + 1e-12


def _synthetic_cohort(spark):
    """One cohort: 11 donors with 30 random pre-period values, treated = .5/.3/.2 donor mix."""
    rng = np.random.default_rng(11)
    Y = rng.normal(size=(11, 30))
    tr = 0.5 * Y[2] + 0.3 * Y[5] + 0.2 * Y[8]
    rows = []
    for u in range(12):
        series = tr if u == 0 else Y[u - 1]
        for t in range(30):
            rows.append(("e", 0, "y", u, t, float(series[t]), 1 if u == 0 else 0, 29, 0))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["exposure", "treated_unit", "outcome", "u", "t", "Y",
                                                             "treated", "event_time", "day_one"]))


def test_synth_weights_recover_mix_and_placebos_are_valid(spark):
    coh = _synthetic_cohort(spark)
    pred = synth.predictors(coh, cols=["Y"])
    w = synth.synth_weights(pred, placebo=True, fits_per_shard=5, solver_partitions=3).toPandas()
    assert w["fit_unit"].nunique() == 12                      # treated + 11 placebo fits over 3 shards
    sums = w.groupby("fit_unit")["weight"].sum()
    assert np.allclose(sums.to_numpy(), 1.0, atol=1e-12) and (w["weight"] >= 0).all()
    tw = w[w.fit_unit == 0].set_index("donor")["weight"]
    assert abs(tw.get(3, 0) - 0.5) < 1e-10 and abs(tw.get(6, 0) - 0.3) < 1e-10 and abs(tw.get(9, 0) - 0.2) < 1e-10
    assert not (w[w.fit_unit != 0]["donor"] == 0).any()        # placebos never use the treated unit
    assert not (w["donor"] == w["fit_unit"]).any()


def test_weighted_series_equals_uniform_path(spark):
    coh = _synthetic_cohort(spark)
    units = coh.select("u", "treated").distinct().toPandas()
    rows = []
    for f in units.itertuples():
        donors = [d for d in units.u if d != f.u and d != 0]
        rows += [("e", 0, "y", int(f.u), int(d), 1.0 / len(donors)) for d in donors]
    wts = spark.createDataFrame(rows, "exposure string, treated_unit int, outcome string, fit_unit int, donor int, "
                                      "weight double")
    a = infer.synth_series(coh, weights=wts).toPandas().sort_values(["fit_unit", "t"]).reset_index(drop=True)
    b = infer.synth_series(coh).toPandas().sort_values(["fit_unit", "t"]).reset_index(drop=True)
    assert np.allclose(a["synth"], b["synth"], atol=1e-12)


def test_placebo_pvalue_counts_placebos_only(spark):
    # treated gap 5 at t=1; placebo gaps 1, 6, -7 -> p = 1/3 (only 6 is >= 5); pre gaps all 1
    rows = []
    for fit, post in [(0, 5.0), (1, 1.0), (2, 6.0), (3, -7.0)]:
        rows.append(("e", 0, "y", fit, 0, 1.0, 0.0, 1.0, int(fit == 0), 1))
        rows.append(("e", 0, "y", fit, 1, post, 0.0, post, int(fit == 0), 1))
    g = spark.createDataFrame(rows, "exposure string, treated_unit int, outcome string, fit_unit int, t int, "
                                    "Y double, synth double, gap double, treated_fit int, event_time int")
    p = infer.placebo_pvalues(g).first()
    assert p["pval"] == pytest.approx(1 / 3) and p["n_placebos"] == 3 and p["lead"] == 0


@pytest.mark.parametrize("closed_form", [True, False])
def test_fe_counterfactual_noiseless(spark, closed_form):
    rng = np.random.default_rng(5)
    a, g = rng.normal(size=20), rng.normal(size=40)
    rows = []
    for i in range(20):
        for t in range(40):
            x = float(rng.normal())
            d = int(i == 0 and t >= 25)
            rows.append(("e", 0, "y", i, t, float(a[i] + g[t] + 0.7 * x + 2.5 * d), x, d, 25))
    df = spark.createDataFrame(rows, "exposure string, treated_unit int, outcome string, u int, t int, Y double, "
                                     "mob double, treat int, event_time int")
    res = fe.fe_counterfactual(df, closed_form=closed_form)
    att = fe.att_by_time(res).toPandas()
    assert np.allclose(att["beta"], 0.7, atol=1e-8)
    assert np.allclose(att["att"], 2.5, atol=1e-8) and len(att) == 15
    assert res.filter(F.col("treat") == 0).agg(F.max(F.abs("effect"))).first()[0] < 1e-8


def test_wide_pool_is_exact_and_fast():
    import time
    rng = np.random.default_rng(21)
    X = rng.normal(size=(60, 1500))
    b = X @ np.full(1500, 1 / 1500) + rng.normal(size=60) * 3
    t0 = time.perf_counter()
    w, gap = simplex_least_squares(X, b)
    assert time.perf_counter() - t0 < 5 and gap <= 1e-10
    g = X.T @ (X @ w - b)
    assert abs(w.sum() - 1) < 1e-12 and w.min() >= 0 and np.all(g >= g[w > 0].mean() - 1e-6)


def test_repeated_and_degenerate_donors():
    x = np.array([[1.0, 1.0, 3.0], [2.0, 2.0, 0.0]])
    for b in (x[:, 0], np.array([2.0, 1.0]), np.array([9.0, 9.0])):
        w, gap = simplex_least_squares(x, b)
        assert abs(w.sum() - 1) < 1e-12 and w.min() >= 0 and gap <= 1e-10
    w, _ = simplex_least_squares(np.zeros((2, 3)), np.zeros(2))
    assert abs(w.sum() - 1) < 1e-12


def test_regression_importance_hand_solved():
    # the outcome is 2 * first + 0 * second predictor
    X = np.array([[1.0, 0.0, 2.0], [2.0, 1.0, 4.0], [3.0, 0.0, 6.0], [4.0, 1.0, 8.0]])
    v = synth.regression_importance(X, np.array([False, False, True]))
    # smallest-norm solution of y = 2a in the span of a and y = 2a: (0.2 * 2, 0, 0.8) on (a, c, y)
    assert np.allclose(v, np.array([0.16, 0.0, 0.64]) / 0.8)


def test_regression_weights_recover_mix(spark):
    pred = synth.predictors(_synthetic_cohort(spark), cols=["Y"])
    w = synth.synth_weights(pred, placebo=False, v="regression").toPandas().set_index("donor")["weight"]
    assert abs(w[3] - 0.5) < 1e-6 and abs(w[6] - 0.3) < 1e-6 and abs(w[9] - 0.2) < 1e-6


def test_unconverged_fixed_effects_raise(spark):
    rng = np.random.default_rng(6)
    rows = [("e", 0, "y", i, t, float(rng.normal() * 1e6), float(rng.normal()), int(i == 0 and t > 5), 6)
            for i in range(6) for t in range(9) if (i * 7 + t * 3) % 4]       # ragged: no closed form
    df = spark.createDataFrame(rows, "exposure string, treated_unit int, outcome string, u int, t int, Y double, "
                                     "mob double, treat int, event_time int")
    with pytest.raises(RuntimeError, match="converged"):
        fe.fe_counterfactual(df, max_rounds=2)
    full = fe.fe_counterfactual(df)
    r = full.filter("treat = 0").toPandas()
    x = r.merge(df.toPandas()[["u", "t", "mob"]], on=["u", "t"])
    for by in ("u", "t"):                                    # residuals are free of both effects and the covariate
        assert np.abs(x.groupby(by)["effect"].mean()).max() < 1e-3
    assert abs((x["effect"] * x["mob"]).sum()) < 1e-2


def test_closed_form_equals_iteration(spark):
    rng = np.random.default_rng(8)
    rows = [("e", 0, "y", i, t, float(rng.normal()), float(rng.normal() * 1e5), int(i == 0 and t > 5), 6) for i in range(7) for t in range(10)]
    rows += [("e", 9, "y", i, t, float(rng.normal() * 1e6), float(rng.normal()), 0, None) for i in range(4) for t in range(5)]
    df = spark.createDataFrame(rows, "exposure string, treated_unit int, outcome string, u int, t int, Y double, "
                                     "mob double, treat int, event_time int")
    by = ["treated_unit", "u", "t"]
    a = fe.fe_counterfactual(df).toPandas().sort_values(by).reset_index(drop=True)
    b = fe.fe_counterfactual(df, closed_form=False).toPandas().sort_values(by).reset_index(drop=True)
    assert np.allclose(a["effect"], b["effect"], rtol=1e-8, atol=1e-9)


SPLIT = "exposure string, treated_unit int, outcome string, u int, t int, Y double, mob double, treat int, event_time int"


def test_effects_across_parts_are_not_identified(spark):
    """Unit 0 is untreated before t = 3, the donors are seen from t = 3 on: no row links them."""
    rows = [("e", 0, "y", 0, t, 39.0 + t, float(t % 2), int(t >= 3), 3) for t in range(6)]
    rows += [("e", 0, "y", u, t, float(u + t), float((u * t) % 3), 0, 3) for u in (1, 2, 3) for t in range(3, 6)]
    # the same with one donor row more: unit 1 at t = 2 links the parts
    rows += [(*("f", *r[1:4]), *r[4:]) for r in list(rows)] + [("f", 0, "y", 1, 2, 3.0, 2.0, 0, 3)]
    out = fe.fe_counterfactual(spark.createDataFrame(rows, SPLIT)).toPandas()
    treated = out[out.treat == 1]
    assert treated[treated.exposure == "e"][["effect", "y0_hat"]].isna().all().all()
    assert treated[treated.exposure == "f"]["effect"].notna().all() and out[out.treat == 0]["effect"].notna().all()
    cert = fe.fe_certificates(spark.createDataFrame(rows, SPLIT)).toPandas().set_index("exposure")
    assert cert.loc["e", "parts"] == 2 and cert.loc["f", "parts"] == 1 and (cert["rounds"] > 0).all()


def test_time_parts_of_long_paths(spark):
    """Units that link neighbouring times only: a path of 40 times, cut at 25."""
    from panelfx.operators.graph import time_parts
    rows = [("k", f"u{t}", t + d) for t in range(40) for d in (0, 1) if t != 24] + [("k", None, 24), ("k", "z", None), ("m", "a", 7)]
    got = {(r.k, r.t): r.part for r in time_parts(spark.createDataFrame(rows, "k string, u string, t int"), ["k"], "u", "t").collect()}
    assert got == {**{("k", t): 0 if t < 25 else 25 for t in range(41)}, ("m", 7): 7}


def test_conjugate_gradients_equal_dense_least_squares(spark):
    rng = np.random.default_rng(12)
    rows = []
    for c in range(3):
        for u in range(12):
            for t in range(15):
                if rng.random() < 0.45 or t == u:
                    rows.append(("e", c, "y", u, t, float(rng.normal() * 10 ** (3 * c)), float(rng.normal()), int(u == 0 and t >= 9), 9))
    rows += [("e", 0, "y", 30, 2, None, 1.0, 0, 9), ("e", 0, "y", 30, 4, 5.0, None, 0, 9)]      # never fitted
    got = fe.fe_counterfactual(spark.createDataFrame(rows, SPLIT), closed_form=False).toPandas()
    for c in range(3):
        part = [r for r in rows if r[1] == c]
        fit = [r for r in part if not r[7] and r[5] is not None and r[6] is not None]
        design = np.zeros((len(fit), 12 + 15 + 1))
        for i, r in enumerate(fit):
            design[i, r[3]] = design[i, 12 + r[4]] = 1
            design[i, -1] = r[6]
        coef = np.linalg.lstsq(design, np.array([r[5] for r in fit]), rcond=None)[0]
        mine = got[got.treated_unit == c].set_index(["u", "t"])
        assert np.allclose(mine["beta"], coef[-1], rtol=1e-8)
        for r in part:
            if r[3] == 30:
                assert np.isnan(mine.loc[(30, r[4]), "effect"])
            elif r[4] in {f[4] for f in fit}:
                assert np.isclose(mine.loc[(r[3], r[4]), "effect"], r[5] - (coef[r[3]] + coef[12 + r[4]] + coef[-1] * r[6]), atol=1e-7 * 10 ** (3 * c))


def test_synth_weights_with_string_units(spark):
    coh = _synthetic_cohort(spark).withColumn("u", F.concat(F.lit("unit-"), F.col("u").cast("string")))
    coh = coh.withColumn("treated_unit", F.lit("unit-0"))
    w = synth.synth_weights(synth.predictors(coh, cols=["Y"]), placebo=False).toPandas()
    assert set(w["fit_unit"]) == {"unit-0"}
    tw = w.set_index("donor")["weight"]
    assert abs(tw["unit-3"] - 0.5) < 1e-10 and abs(tw["unit-6"] - 0.3) < 1e-10 and abs(tw["unit-9"] - 0.2) < 1e-10


def test_synth_weights_refuse_ragged_predictors(spark):
    from pyspark.errors import PythonException
    coh = _synthetic_cohort(spark).filter(~((F.col("u") == 4) & (F.col("t") == 3)))   # one value missing
    with pytest.raises(Exception) as e:
        synth.synth_weights(synth.predictors(coh, cols=["Y"])).collect()
    assert "different predictor sets" in str(e.value) or isinstance(e.value, PythonException)
    # units that lack different times have equally many predictors: refused as well
    ragged = _synthetic_cohort(spark).filter("NOT (u > 0 AND t = u)")
    with pytest.raises(Exception):
        synth.synth_weights(synth.predictors(ragged, cols=["Y"])).collect()
    one = _synthetic_cohort(spark).filter(~((F.col("u") == 4) & (F.col("t") == 3)))
    left = synth.synth_weights(synth.predictors(one, cols=["Y"]), on_gap="drop").toPandas()
    assert 4 not in set(left["donor"]) | set(left["fit_unit"]) and left["fit_unit"].nunique() == 11


def test_effects_with_solved_weights(spark):
    """Y5-Y9 on solver weights: the treated unit is an exact donor mix before the event, so
    its pre-period gap is 0; p-values lie in [0, 1], ti counts the post-event times."""
    coh = _synthetic_cohort(spark).withColumn("event_time", F.lit(20))
    w = synth.synth_weights(synth.predictors(coh, cols=["Y"]), placebo=True)
    g = infer.synth_series(coh, weights=w)
    pre = g.filter((F.col("treated_fit") == 1) & (F.col("t") < 20)).agg(F.max(F.abs("gap"))).first()[0]
    assert pre < 1e-9
    e = infer.effect_table(g, infer.placebo_pvalues(g)).toPandas().sort_values("t")
    assert list(e["ti"]) == list(range(1, 11)) and list(e["lead"]) == list(range(10))
    assert e["pval"].between(0, 1).all()
    ok = e["zval"] > 0
    assert (e.loc[ok, "ci_low"] <= e.loc[ok, "ci_high"]).all()
