"""Factorised cohorts against the expanded ones, ranks against plain counting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfx import PanelSpec
from panelfx.operators import cohort, columns, events, fe, infer, pools, ranks, synth

SPEC = PanelSpec("u", "t")
KEYS = cohort.COHORT_KEYS


def panel(spark, units=14, times=20, seed=0):
    """Every third unit is exposed from t = 10 + u % 4 on, one time only ("seldom", so that it stays a
    donor of the others) and five times ("often")."""
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(units):
        for t in range(times):
            hit = u % 3 == 0
            rows.append((u, t, float(rng.normal()), float(rng.normal()), float(rng.normal() * 100),
                         int(hit and t == 10 + u % 4), int(hit and 10 + u % 4 <= t < 15 + u % 4)))
    return spark.createDataFrame(rows, "u int, t int, y1 double, y2 double, mob double, seldom int, often int")


RULES = cohort.CohortRules(covariate="mob", outcome_limit=2.5, max_share=0.06)
FLAGS = {"seldom": "seldom", "often": "often"}


def both(spark, seed):
    p = panel(spark, seed=seed)
    grid = cohort.cohort_grid(p.filter("u % 3 = 0"), "u", list(FLAGS), ["y1", "y2"])
    args = (p, SPEC, grid, ["y1", "y2"], FLAGS, RULES)
    return cohort.build_cohorts(*args), pools.build_pools(*args)


def near(a, b, by):
    a, b = (x.toPandas().sort_values(by).reset_index(drop=True)[sorted(x.columns)] for x in (a, b))
    assert len(a) == len(b) > 0
    for c in a.columns:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c].astype(float), rtol=1e-9, atol=1e-12, equal_nan=True), c
        else:
            assert (a[c] == b[c]).all(), c


@pytest.mark.parametrize("seed", [0, 3])
def test_pools_equal_expanded_cohorts(spark, seed):
    coh, pool = both(spark, seed)
    assert {r.in_pool for r in pool.cohorts.select("in_pool").collect()} == {True, False}
    assert pool.rows.count() <= 14 * 20 * 4                       # linear in the panel, whatever is treated
    flagged = coh.withColumn("treat", events.treated_flag(F.col("u"), F.col("treated_unit"), F.col("t"), F.col("event_time")))
    # a cohort that lost its treated unit has no effect
    near(pools.fe_att(pool), fe.att_by_time(fe.fe_counterfactual(flagged)), [*KEYS, "rel_time"])
    gaps = infer.synth_series(coh)
    near(pools.placebo_pvalues(pool), infer.placebo_pvalues(gaps), [*KEYS, "t"])
    near(pools.placebo_pvalues(pool, standardize=False), infer.placebo_pvalues(gaps, standardize=False), [*KEYS, "t"])


@pytest.mark.parametrize("seed", [0, 3])
def test_pool_weights_equal_expanded_cohorts(spark, seed):
    """Predictors, weights and gaps of the treated units, with no row per cohort and donor; a predictor
    without spread leaves, and a treated unit that is one of the pool's donors is none of its own."""
    p = panel(spark, seed=seed).withColumn("mob", F.when(F.col("t") == 5, 0.1).otherwise(F.col("mob")))
    grid = cohort.cohort_grid(p.filter("u % 3 = 0"), "u", list(FLAGS), ["y1", "y2"])
    args = (p, SPEC, grid, ["y1", "y2"], FLAGS, RULES)
    coh, pool = cohort.build_cohorts(*args), pools.build_pools(*args)
    assert pool.treated.filter("in_pool").count() and pool.treated.filter("NOT in_pool").count()
    full = synth.predictors(coh, cols=["Y", "mob"])
    pred = synth.pool_predictors(pool)
    own = full.filter("treated = 1").withColumn("var", F.when(F.col("var") == "mob", "c").otherwise(F.col("var")))
    near(pred.select(*KEYS, "var", "t", "x", "sd", "x_scaled"), own.select(*KEYS, "var", "t", "x", "sd", "x_scaled"), [*KEYS, "var", "t"])
    assert not pred.filter("var = 'c' AND t = 5").count()
    donors, fits = synth.pool_vectors(pool, pred)
    assert donors.count() == pool.rows.select("exposure", "outcome", "u").distinct().count()
    got = columns.synth_weights_pools(donors, fits, columns=3, block_bytes=2000).toPandas()
    want = columns.synth_weights_columns(full, placebo=False).toPandas()
    by = [*KEYS, "fit_unit", "donor"]
    assert list(got.columns) == list(want.columns) and not (got.donor == got.treated_unit).any() and (got.gap <= 1e-8).all()
    both_ = got.merge(want, on=by, how="outer", suffixes=("", "_w")).fillna(0.0)
    assert len(want) and np.allclose(both_.weight, both_.weight_w, atol=1e-5)
    rmse = got.merge(want, on=by, suffixes=("", "_w"))
    assert np.allclose(rmse.fit_rmse, rmse.fit_rmse_w, rtol=1e-6)


def test_pool_with_missing_predictors_is_refused(spark):
    rules = cohort.CohortRules(covariate="mob", outcome_limit=None, max_share=0.06, drop_gaps=False)
    for gone, said in (("u = 1 AND t = 4", "units of a pool"), ("u = 3 AND t = 4", "a treated unit")):
        p = panel(spark).filter(f"NOT ({gone})")
        grid = cohort.cohort_grid(p.filter("u % 3 = 0"), "u", ["often"], ["y1"])
        pool = pools.build_pools(p, SPEC, grid, ["y1"], {"often": "often"}, rules)
        with pytest.raises(ValueError, match=said):
            synth.pool_vectors(pool, synth.pool_predictors(pool))


def test_unbalanced_pool_is_refused(spark):
    p = panel(spark).filter("NOT (u = 1 AND t = 4)")
    grid = cohort.cohort_grid(p.filter("u % 3 = 0"), "u", ["often"], ["y1"])
    rules = cohort.CohortRules(covariate="mob", outcome_limit=None, max_share=0.06, drop_gaps=False)
    with pytest.raises(ValueError, match="not balanced"):
        pools.fe_att(pools.build_pools(p, SPEC, grid, ["y1"], {"often": "often"}, rules))


def test_rank_counts(spark):
    rng = np.random.default_rng(4)
    points = [(rng.choice(["a", "b", None]), float(rng.integers(0, 30))) for _ in range(900)] + [("a", 7.0)] * 500 + [("a", None)] * 3
    asked = [(i, rng.choice(["a", "b", None, "none"]), float(rng.integers(-2, 33))) for i in range(80)] + [(80, "a", None), (81, "a", 7.0)]
    got = ranks.rank_counts(spark.createDataFrame(points, "k string, v double").repartition(5),
                            spark.createDataFrame(asked, "i int, k string, v double"), ["k"], "v").collect()
    assert len(got) == len(asked)
    for r in got:
        mine = [v for k, v in points if k == r.k and v is not None]
        want = (None, None) if r.v is None else (sum(v < r.v for v in mine), sum(v <= r.v for v in mine))
        assert (r.n_below, r.n_upto, r.n_points) == (*want, len(mine))


def test_expanded_cohorts_write_no_pairs(spark, monkeypatch):
    """Rows of every cohort against plain selection, ids and first times against ranks and minima, and
    nothing written that has a row for each cohort and unit."""
    p = panel(spark, units=60, times=6, seed=5).withColumn("y1", F.when((F.col("u") == 9) & (F.col("t") == 2), None).otherwise(F.col("y1")))
    p = p.withColumns({"seldom": F.when(F.col("u") % 3 == 0, (F.col("t") == F.col("u") % 5).cast("int")).otherwise(0),
                       "often": F.when(F.col("u") % 6 == 0, (F.col("t") >= 2).cast("int")).otherwise(0)})
    grid = cohort.cohort_grid(p.filter("u % 3 = 0"), "u", list(FLAGS), ["y1", "y2"])
    rules = cohort.CohortRules(covariate="mob", outcome_limit=2.5, max_share=0.2)
    written, real = [], cohort.materialize

    def counted(df, name="fork"):
        out = real(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(cohort, "materialize", counted)
    got = cohort.build_cohorts(p, SPEC, grid, ["y1", "y2"], FLAGS, rules, carry=["y2"]).toPandas()
    pd_ = p.toPandas()
    assert max(written) <= 4 * len(pd_) < len(got) / 6 / 2
    want = 0
    for y in ("y1", "y2"):
        whole = set(pd_.u) - set(pd_[pd_[y].isna()].u)
        low = {u for u in whole if not (pd_[pd_.u == u][y] > 2.5).any()}
        for e in FLAGS:
            share, event = pd_.groupby("u")[e].mean(), pd_[pd_[e] == 1].groupby("u").t.min()
            for k in range(0, 60, 3):
                units = sorted({u for u in low if share[u] <= 0.2} | ({k} & whole))
                rows = got[(got.exposure == e) & (got.outcome == y) & (got.treated_unit == k)]
                want += len(units) * 6
                assert sorted(zip(rows.u, rows.t)) == [(u, t) for u in units for t in range(6)]
                assert (rows.id == rows.u.map({u: i + 1 for i, u in enumerate(units)})).all()
                assert (rows.treated == (rows.u == k)).all() and (rows.day_one == 0).all()
                assert (rows.event_time.isna().all() if k not in event else (rows.event_time == event[k]).all())
                assert np.allclose(rows.avg_exposed, rows.u.map(share))
    assert len(got) == want
    monkeypatch.setattr(cohort, "TASK_ROWS", 100)
    dealt = cohort.build_cohorts(p, SPEC, grid, ["y1", "y2"], FLAGS, rules, carry=["y2"], broadcast_cohorts=7)
    assert dealt.count() == want and dealt.exceptAll(spark.createDataFrame(got, dealt.schema)).count() == 0


def test_cohort_rows_come_from_arrays_in_one_stream(spark, monkeypatch):
    """The returned rows are made by one inline of the cohorts' arrays, with no union behind it and no join
    that has a row for each cohort; a donor's row meets one table row for each array, the row of a treated
    unit that is no donor its own cohort's alone."""
    p = panel(spark, units=60, times=6, seed=5).select(F.format_string("k%02d", "u").alias("u"), "t", "y1", "mob", "often", (F.col("u") % 3 == 0).alias("hit"))
    p = p.withColumn("often", (F.col("hit") & (F.col("t") >= 2)).cast("int"))
    grid = cohort.cohort_grid(p.filter("hit"), "u", ["often"], ["y1"]).unionByName(spark.createDataFrame([("often", "none", "y1"), (None, "k01", "y1")], "exposure string, treated_unit string, outcome string"))
    rules = cohort.CohortRules(covariate="mob", outcome_limit=None, max_share=0.2)
    whole = cohort.build_cohorts(p, SPEC, grid, ["y1"], {"often": "often"}, rules)
    node, seen = whole._jdf.queryExecution().optimizedPlan(), []
    while node.nodeName() in ("Project", "Generate", "Filter"):
        seen.append(node.nodeName())
        node = node.children().apply(0)
    assert node.nodeName() == "Join" and seen.count("Generate") == 1
    table = {node.children().apply(i).output().mkString(",") for i in range(2)}
    assert sum("__cohorts" in x for x in table) == 1
    got = whole.toPandas()
    donors = [f"k{u:02d}" for u in range(60) if u % 3]
    assert len(got) == (21 * 40 + 20) * 6 and set(got.treated_unit) == {f"k{u:02d}" for u in range(0, 60, 3)} | {"none"}
    for k, rows in got.groupby("treated_unit"):
        units = sorted({*donors, *({k} - {"none"})})
        assert sorted(zip(rows.u, rows.t)) == [(u, t) for u in units for t in range(6)]
        assert (rows.id == rows.u.map({u: i + 1 for i, u in enumerate(units)})).all() and (rows.treated == (rows.u == k)).all()
    monkeypatch.setattr(cohort, "ARRAY_COHORTS", 4)
    for bound in (200_000, 20):            # arrays broadcast, arrays dealt to blocks
        some = cohort.build_cohorts(p, SPEC, grid, ["y1"], {"often": "often"}, rules, broadcast_cohorts=bound)
        assert some.count() == len(got) and some.exceptAll(whole).count() == 0


def test_ragged_pools_equal_expanded_cohorts(spark, monkeypatch):
    """The fit from shared sums against the solver on the expanded cohorts: gaps, donors that change at one
    time (two connected parts), treated units among the donors, one that fails a rule; and no written
    table has a row for each cohort and unit."""
    p = panel(spark, units=60, times=10, seed=3).filter("pmod(hash(u, t), 5) <> 0")
    p = p.withColumn("y1", F.when((F.col("u") == 9) & (F.col("t") == 1), None).otherwise(F.col("y1")))
    p = p.withColumns({"seldom": F.lit(0), "often": F.when((F.col("u") % 6 == 0), (F.col("t") >= 4 + F.col("u") % 4).cast("int")).otherwise(0)})
    grid = cohort.cohort_grid(p.filter("u % 3 = 0"), "u", list(FLAGS), ["y1", "y2"])
    rules = cohort.CohortRules(drop_gaps=False, covariate="mob", outcome_limit=None, max_share=0.01)
    args = (p, SPEC, grid, ["y1", "y2"], FLAGS, rules)
    stays = ((F.col("t") < 5) & (F.col("u") % 2 == 0)) | ((F.col("t") >= 5) & (F.col("u") % 2 == 1))
    coh = cohort.build_cohorts(*args).filter((F.col("treated") == 1) | stays)
    coh = coh.withColumn("treat", events.treated_flag(F.col("u"), F.col("treated_unit"), F.col("t"), F.col("event_time")))
    want = fe.fe_certificates(coh).toPandas().set_index(KEYS).sort_index()
    att = fe.att_by_time(fe.fe_counterfactual(coh, closed_form=False)).toPandas().set_index([*KEYS, "rel_time"]).sort_index()
    written, real = [], pools.materialize

    def counted(df, name="fork"):
        out = real(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(pools, "materialize", counted)
    found = pools.build_pools(*args, keep_lost=True)
    fits = pools.materialize(pools.fe_ragged(pools.Pools(found.rows.filter(stays), found.cohorts, found.treated)))
    got = fits.toPandas().set_index(KEYS).sort_index()
    assert list(got.index) == list(want.index) and (got.parts == want.parts).all() and set(got.parts) >= {1, 2}
    assert (got[["residual_y", "residual_x"]] < 1e-10).all(axis=None) and (got.rounds > 0).all()
    mine = pools.att_of(fits).toPandas().set_index([*KEYS, "rel_time"]).sort_index()
    assert list(mine.index) == list(att.index) and (mine.n_treated == att.n_treated).all() and set(mine.n_treated) == {0, 1}
    assert np.allclose(mine.att, att.att, rtol=1e-8, equal_nan=True) and np.allclose(mine.beta, att.beta, rtol=1e-8)
    assert max(written) <= 4 * p.count() < coh.count() / 5
