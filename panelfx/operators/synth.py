"""Synthetic-control weights.

Y2  `predictors`: every outcome and covariate value from the cohort's first time to
    the treated unit's event time (inclusive by default) is one predictor; each is
    scaled by its standard deviation across the cohort's units (an aggregate per
    (cohort, predictor), joined back); predictors with zero spread are dropped.
Y3  `synth_weights`: for a fit unit f with donors D, the weights solve
        min_w (x_f - X_D w)' V (x_f - X_D w)   subject to  w >= 0, sum(w) = 1
    on the scaled predictors. `v="equal"` weighs all predictors alike;
    `v="regression"` weighs predictor k by the squared coefficients of regressing the
    pre-event outcomes on the predictors over all units of the cohort (the smallest-norm
    solution where there are more predictors than units), scaled to sum to one.
Y4  with `placebo=True` every unit of the cohort is fitted; a placebo's donors are
    all units except itself and the treated unit. The scaling uses all units of the
    cohort for every fit, the treated one included.

Solver: Wolfe's active-set method for the point of smallest norm in the convex hull of
the donors' differences from the fit unit. It ends after finitely many steps with a
proof: the duality gap of the returned weights, which bounds their distance from the
optimal loss, is part of the output (`gap`, relative to the largest squared
difference). A fit whose gap does not fall below `tol` raises; nothing unconverged is
returned.

Distribution: the predictors of a unit are packed into one array row per
(cohort, unit), in (predictor, time) order; units whose predictor keys differ from
those of the treated unit are refused (`on_gap="raise"`) or dropped
(`on_gap="drop"`). A cohort's fits are hashed into as many shards as there are solver
partitions per cohort; each shard task receives the cohort's unit arrays (U rows, K
values each), so what is copied is bounded by U x K per solver partition, and unit
pairs never become rows. Every donor is always used (no candidate cap); the output
holds only positive weights (at most K + 1 per fit).
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .cohort import COHORT_KEYS

try:  # ship this module's solver code with the task, so workers need no installed copy
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # older pickler: rely on the package being on the executors' path
    pass


def predictors(cohorts: DataFrame, cols: Sequence[str] = ("Y",), unit: str = "u", t: str = "t",
               include_event: bool = True) -> DataFrame:
    """Y2: (cohort keys, unit, treated, var, t, x, sd, x_scaled) for the pre-period
    [day_one, event_time] (or [day_one, event_time) without the event)."""
    upper = (F.col(t) <= F.col("event_time")) if include_event else (F.col(t) < F.col("event_time"))
    pre = cohorts.filter((F.col(t) >= F.col("day_one")) & upper)
    long = (pre.select(*COHORT_KEYS, unit, "treated", t, *cols)
            .unpivot([*COHORT_KEYS, unit, "treated", t], list(cols), "var", "x"))
    sd = long.groupBy(*COHORT_KEYS, "var", t).agg(F.stddev_samp("x").alias("sd")).filter(F.col("sd") > 0)
    out = long.join(sd, [*COHORT_KEYS, "var", t]).withColumn("x_scaled", F.col("x") / F.col("sd"))
    return out.select(*COHORT_KEYS, unit, "treated", t, "var", "x", "sd", "x_scaled")


def pool_predictors(pools) -> DataFrame:
    """Y2 for the treated units of ``pools.Pools``: (cohort keys, var, t, x, sd, x_scaled, s, m), as `predictors`
    gives on the expanded cohorts. The spread of a cohort is its pool's with the treated unit added; s and
    m are the sum over its donors (unscaled) and their number."""
    pool = ["exposure", "outcome"]
    rows, tr = pools.rows.withColumnRenamed("x", "c"), pools.treated.withColumnRenamed("x", "c")
    cols = ["Y", "c"]
    x = F.col("x")
    by = rows.unpivot([*pool, "u", "t"], cols, "var", "x").groupBy(*pool, "var", "t").agg(
        F.count(x).alias("n"), F.sum(x).alias("s"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"),
        F.min(x).alias("low"), F.max(x).alias("high"))
    first = rows.groupBy(*pool).agg(F.min("t").alias("__t0"))
    own = tr.groupBy(*COHORT_KEYS, "event_time", "in_pool").agg(F.min("t").alias("__own")).join(first, pool)
    grid = own.join(by, pool).filter(F.col("t").between(F.least("__t0", "__own"), F.col("event_time")))
    tr = grid.join(tr.select(*COHORT_KEYS, "t", *cols).unpivot([*COHORT_KEYS, "t"], cols, "var", "x"), [*COHORT_KEYS, "var", "t"], "left")
    tr = materialize(tr, "pool_grid")
    if tr.filter(x.isNull() & (F.col("low") < F.col("high"))).limit(1).count():
        raise ValueError("a treated unit lacks predictors its pool has (times or values are missing); "
                         "drop such units before fitting (CohortRules does by default)")
    d, n = x - F.col("mean"), F.col("n")
    inside = F.col("in_pool")
    var = F.when(inside, F.try_divide("m2", n - 1)).otherwise((F.col("m2") + d * d * n / (n + 1)) / n)
    tr = tr.withColumn("sd", F.sqrt(var)).filter((F.col("sd") > 0) & (F.least("low", x) < F.greatest("high", x)))
    return tr.select(*COHORT_KEYS, "var", "t", "x", "sd", (x / F.col("sd")).alias("x_scaled"),
                     (F.col("s") - F.when(inside, x).otherwise(0.0)).alias("s"), (n - F.when(inside, 1).otherwise(0)).alias("m"))


def pool_vectors(pools, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exposure, outcome, unit, x) for the pools' donors, unscaled and once for all cohorts, and (exposure, outcome,
    fit_unit, b, by) for the treated units of `pred` (`pool_predictors`): their scaled predictors and one over the
    spread of each, zero for what is no predictor of that cohort. Both in (predictor, time) order."""
    pool = ["exposure", "outcome"]
    last = pools.cohorts.groupBy(*pool).agg(F.max("event_time").alias("__last"))
    rows = pools.rows.join(last, pool).filter(F.col("t") <= F.col("__last")).drop("__last").withColumnRenamed("x", "c")
    long = rows.unpivot([*pool, "u", "t"], ["Y", "c"], "var", "x")
    cells = long.groupBy(*pool, F.col("u").alias("unit")).agg(F.array_sort(F.collect_list(F.struct("var", "t", "x"))).alias("__p"))
    keys_of = F.transform("__p", lambda s: F.struct(s["var"], s["t"]))
    cells = materialize(cells.withColumn("__k", keys_of), "pool_vectors")
    shapes = cells.groupBy(*pool, "__k").agg(F.max(F.exists("__p", lambda s: s["x"].isNull()).cast("int")).alias("gap"))
    shapes = materialize(shapes, "pool_shapes")
    if shapes.groupBy(*pool).agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("gap")).filter("n > 1 OR gap > 0").limit(1).count():
        raise ValueError("units of a pool have different predictor sets (times or values are missing); "
                         "drop such units before fitting (CohortRules does by default)")
    place = shapes.select(*pool, F.explode("__k").alias("k")).select(*pool, "k.var", "k.t")
    grid = pred.select(*COHORT_KEYS).distinct().join(place, pool)
    at = grid.join(pred, [*COHORT_KEYS, "var", "t"], "left").select(
        *COHORT_KEYS, "var", "t", F.coalesce("x_scaled", F.lit(0.0)).alias("b"), F.coalesce(1 / F.col("sd"), F.lit(0.0)).alias("by"))
    fits = at.groupBy(*COHORT_KEYS).agg(F.array_sort(F.collect_list(F.struct("var", "t", "b", "by"))).alias("p"))
    return (cells.select(*pool, "unit", F.col("__p.x").alias("x")),
            materialize(fits.select(*pool, F.col("treated_unit").alias("fit_unit"), F.col("p.b").alias("b"), F.col("p.by").alias("by")), "pool_fits"))


# ------------------------------------------------------------------ numeric kernel (runs inside tasks)

def _affine_minimum(G: np.ndarray) -> np.ndarray:
    """v with sum(v) = 1 that minimises v'Gv (G positive semidefinite)."""
    n = len(G)
    kkt = np.ones((n + 1, n + 1))
    scale = max(float(np.trace(G)) / n, 1e-300)
    kkt[:n, :n] = G / scale
    kkt[n, n] = 0.0
    rhs = np.zeros(n + 1)
    rhs[n] = 1.0
    v = np.linalg.lstsq(kkt, rhs, rcond=None)[0][:n]
    return v / v.sum()


def simplex_least_squares(A: np.ndarray, b: np.ndarray, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """min ||A w - b||^2 over the probability simplex (A is K x m): (w, gap).

    Wolfe's method on the columns of A - b: the support grows by the column that
    violates optimality most; on the support the affine minimum is taken, and where it
    leaves the simplex the path to it is cut at the first weight that reaches zero,
    which is removed. `gap` = (x'x - min_j x_j'x) / max_j ||x_j||^2 at x = A w - b
    bounds the loss above the optimum and is 0 at the optimum. Raises if rounding keeps
    it above `tol`. Deterministic; memory is that of A.
    """
    m = A.shape[1]
    if m == 0:
        return np.zeros(0), 0.0
    X = A - b[:, None]
    norms = np.einsum("ij,ij->j", X, X)
    scale = max(float(norms.max()), 1e-300)
    S = [int(norms.argmin())]
    w = np.ones(1)
    best, best_gap = None, np.inf
    for _ in range(20 * (m + X.shape[0]) + 100):
        x = X[:, S] @ w
        g = x @ X
        xx = float(x @ x)
        j = int(g.argmin())
        gap = max(0.0, (xx - float(g[j])) / scale)
        if gap < best_gap:
            best, best_gap = (list(S), w.copy()), gap
        if gap <= tol * 1e-3 or j in S:
            break
        S.append(j)
        w = np.append(w, 0.0)
        while True:
            XS = X[:, S]
            v = _affine_minimum(XS.T @ XS)
            if (v > 0).all():
                w = v
                break
            neg = np.flatnonzero(v <= 0)
            steps = w[neg] / np.maximum(w[neg] - v[neg], 1e-300)
            theta = min(1.0, float(steps.min()))
            w = (1 - theta) * w + theta * v
            w[neg[steps <= theta]] = 0.0
            keep = np.flatnonzero(w > 0)
            S, w = [S[k] for k in keep], w[keep] / w[keep].sum()
            if len(S) == 1:
                break
    if best_gap > tol:
        raise ValueError(f"no optimum within {tol}: the duality gap stays at {best_gap:.3g}")
    out = np.zeros(m)
    out[best[0]] = best[1]
    return out / out.sum(), best_gap


def regression_importance(X: np.ndarray, is_outcome: np.ndarray) -> np.ndarray:
    """V: for predictors X (U x K), the squared coefficients of regressing each outcome
    predictor on all predictors and a constant (least squares of smallest norm), summed
    over the outcomes and scaled to sum to one."""
    Z = X - X.mean(axis=0)
    coef = np.linalg.lstsq(Z, Z[:, is_outcome], rcond=None)[0]
    v = (coef * coef).sum(axis=1)
    return v / v.sum() if v.sum() > 0 else np.full(X.shape[1], 1.0 / X.shape[1])


def weight_schema(key_types: dict, unit_type: T.DataType) -> T.StructType:
    """Output schema: cohort keys with their input types, fit and donor with the unit's type."""
    return T.StructType([*[T.StructField(k, key_types[k]) for k in COHORT_KEYS],
                         T.StructField("fit_unit", unit_type), T.StructField("donor", unit_type),
                         T.StructField("weight", T.DoubleType()), T.StructField("fit_rmse", T.DoubleType()),
                         T.StructField("gap", T.DoubleType())])


def _solver(placebo: bool, v: str, tol: float, names: list[str]):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=names)
        pdf = pdf.sort_values("unit", kind="stable").reset_index(drop=True)
        if pdf["sig"].nunique() != 1:
            raise ValueError("units of a cohort have different predictor sets (times or values are missing); "
                             "drop such units before fitting (CohortRules does by default), or pass on_gap='drop'")
        X = np.vstack(pdf["x"].to_numpy()).astype(float)            # U x K
        F_ = X
        if v == "regression":
            F_ = X * np.sqrt(regression_importance(X, np.asarray(pdf["is_y"].iloc[0], bool)))
        units, treated = pdf["unit"].to_numpy(), pdf["treated"].to_numpy() == 1
        mine = pdf["fit_shard"].to_numpy() == pdf["shard"].to_numpy()
        keys = pdf.iloc[0][COHORT_KEYS].tolist()
        parts = []
        for i in np.flatnonzero(mine & (treated | placebo)):
            donors = np.flatnonzero((np.arange(len(X)) != i) & ~treated)
            if donors.size == 0:
                continue
            w, gap = simplex_least_squares(F_[donors].T, F_[i], tol)
            r = X[donors].T @ w - X[i]
            pos = np.flatnonzero(w > 0)
            parts.append(pd.DataFrame({"fit_unit": [units[i]] * pos.size, "donor": units[donors[pos]], "weight": w[pos],
                                       "fit_rmse": float(np.sqrt(r @ r / max(1, r.size))), "gap": gap}))
        if not parts:
            return pd.DataFrame(columns=names)
        out = pd.concat(parts, ignore_index=True)
        for k, value in zip(COHORT_KEYS, keys):
            out[k] = value
        return out[names]
    return solve


def synth_weights(pred: DataFrame, unit: str = "u", placebo: bool = True, scaled: bool = True, v: str = "equal",
                  on_gap: str = "raise", outcome: str = "Y", tol: float = 1e-8, fits_per_shard: int = 16,
                  solver_partitions: int | None = None) -> DataFrame:
    """(cohort keys, fit_unit, donor, weight, fit_rmse, gap) with weight > 0.

    `pred` is the output of `predictors`. A shard task gets the cohort's unit vectors and
    solves the fits hashed to it; a cohort has at most one shard per `fits_per_shard`
    units, and all cohorts together about `solver_partitions` shards.
    """
    if v not in ("equal", "regression") or on_gap not in ("raise", "drop"):
        raise ValueError("v is 'equal' or 'regression', on_gap is 'raise' or 'drop'")
    xcol = "x_scaled" if scaled else "x"
    packed = F.array_sort(F.collect_list(F.struct("var", "t", F.col(xcol).alias("v"))))
    vec = pred.groupBy(*COHORT_KEYS, unit, "treated").agg(packed.alias("__p"))
    vec = vec.select(*COHORT_KEYS, F.col(unit).alias("unit"), "treated",
                     F.transform("__p", lambda s: s["v"]).alias("x"),
                     F.transform("__p", lambda s: (s["var"] == outcome).cast("int")).alias("is_y"),
                     # the keys themselves, not their number: equal lengths can hide different times
                     F.xxhash64(F.transform("__p", lambda s: F.struct(s["var"], s["t"], s["v"].isNull()))).alias("sig"))
    vec = materialize(vec, "vectors")
    if on_gap == "drop":
        ref = vec.filter(F.col("treated") == 1).select(*COHORT_KEYS, F.col("sig").alias("__ref"))
        vec = vec.join(ref, COHORT_KEYS).filter(F.col("sig") == F.col("__ref")).drop("__ref")
    sc = pred.sparkSession.sparkContext
    nparts = solver_partitions or max(sc.defaultParallelism,
                                      int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sizes = materialize(vec.groupBy(*COHORT_KEYS).agg(F.count(F.lit(1)).alias("__units")), "sizes")
    per_cohort = -(-nparts // max(1, sizes.count()))
    sizes = sizes.select(*COHORT_KEYS, F.least(F.lit(per_cohort), F.ceil(F.col("__units") / F.lit(fits_per_shard)))
                         .cast("int").alias("__n_shards"))
    types = {f.name: f.dataType for f in pred.schema.fields}
    schema = weight_schema(types, types[unit])
    vec = (vec.join(sizes, COHORT_KEYS)
           .withColumn("fit_shard", F.pmod(F.xxhash64("unit"), F.col("__n_shards")).cast("int"))
           .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("__n_shards") - 1)))
           .drop("__n_shards"))
    # The packed vectors are few bytes but each group is CPU-heavy: an explicit partition
    # count keeps AQE from coalescing all groups into one task; the groupBy below reuses
    # this hash partitioning (no second shuffle).
    vec = vec.repartition(nparts, *COHORT_KEYS, "shard")
    solve = _solver(placebo, v, tol, [f.name for f in schema.fields])
    return vec.groupBy(*COHORT_KEYS, "shard").applyInPandas(solve, schema)
