"""Two-way fixed-effect counterfactual with one covariate.

Model on the untreated rows (treat = 0):  y = a_unit + g_time + beta * x + e.
y and x are each freed of unit and time effects fitted on the untreated rows; then
beta = sum(x~ y~) / sum(x~^2) per cohort, and for every row the residual
r_y - beta r_x equals y - (a_unit + g_time + beta x) = y - Y(0): the effect on treated
rows.

Closed form. Where every unit of a cohort but at most one (the treated one) has an
untreated row at every time, the fitted effects are plain means. With the donor mean
m_t by time, its mean m, the donors' means y_d, and the treated unit's offset
delta = mean(y_0t - m_t) and deviation e_t = y_0t - m_t - delta over its untreated
times, of N donors:
    donors          r = y_dt - (y_d - m) - m_t - e_t / (N + 1)      (e_t = 0 where it has none)
    treated unit    r = y_0t - delta - m_t - e_t / (N + 1)
These are a few small aggregates joined to the rows. Whether a cohort qualifies is
decided by its rows, never by its size.

Conjugate gradients. All other cohorts solve the normal equations. With the unit effects
eliminated these are equations in the time effects alone,
    n_t g_t - sum over units i at t of mean_i(g) = sum over units i at t of (y_it - mean_i(y)),
one per time of the cohort. The left side depends on the units only through the sets of times
they are seen at, so units with equal sets are one row with a count; one application of it
is one aggregate over those rows. Conjugate gradients, preconditioned by n_t, run for all cohorts
and for y and x together; a cohort's vectors are arrays in one row (bounded by the calendar)
that is written each round, while the panel's rows are not touched. A cohort stops on its own
scale. The result carries a certificate: the largest time mean of the residuals, computed anew
from the rows; running out of rounds, or a certificate above `CERTIFIED`, raises.

Identification. The effect on a row needs its unit's and its time's effect on one scale: both must
lie in the same connected part of the unit-time graph of the fitted rows (`graph.time_parts`).
Elsewhere the counterfactual is null. Fitted are the untreated rows with outcome and covariate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .cohort import COHORT_KEYS
from .graph import time_parts

CERTIFIED = 1e-8            # largest time mean of the residuals, relative to the largest value
BROADCAST_ENTRIES = 4_000_000   # numbers in the vectors of all cohorts, up to which they are broadcast

_OUT = ["Y", "treat", "event_time", "__x", "__ry", "__rx", "__ident"]


def fe_counterfactual(cohorts: DataFrame, y: str = "Y", cov: str = "mob", treat: str = "treat", unit: str = "u",
                      t: str = "t", keys: Sequence[str] = tuple(COHORT_KEYS), max_rounds: int = 1000,
                      tol: float = 1e-12, closed_form: bool = True) -> DataFrame:
    """Rows: keys, unit, t, Y, treat, y0_hat (counterfactual), effect = Y - y0_hat,
    beta, rel_time = t - event_time. y0_hat is null where the effect is not identified: the unit
    or the time has no fitted row, or no path of fitted rows leads from one to the other.
    closed_form=False solves by conjugate gradients for every cohort."""
    keys = list(keys)
    rows = materialize(cohorts.select(*keys, unit, t, F.col(y).cast("double").alias("Y"), F.col(treat).cast("int").alias("treat"),
                                      "event_time", F.col(cov).cast("double").alias("__x")), "fe_rows")
    res = None
    open_rows = rows
    if closed_form:
        plain, shape = _plain_cohorts(rows, keys, unit, t)
        res = _closed(rows, plain, shape, keys, unit, t)
        if plain.filter("NOT plain").limit(1).count() == 0:
            open_rows = None
        else:
            open_rows = rows.join(plain.filter("NOT plain").select(*keys), keys, "left_semi")
    if open_rows is not None:
        solved = _solved(open_rows, keys, unit, t, max_rounds, tol)[0]
        res = solved if res is None else res.unionByName(solved)
    res = materialize(res, "fe_residuals")                    # read by the slope and by the rows
    beta = (res.filter("treat = 0").groupBy(*keys)
            .agg(F.try_divide(F.sum(F.col("__rx") * F.col("__ry")), F.sum(F.col("__rx") * F.col("__rx"))).alias("beta")))
    res = res.join(beta, keys, "left")
    eff = F.when(F.col("__ident"), F.col("__ry") - F.coalesce(F.col("beta"), F.lit(0.0)) * F.col("__rx"))
    return res.select(*keys, unit, t, "Y", "treat", (F.col("Y") - eff).alias("y0_hat"), eff.alias("effect"),
                      "beta", (F.col(t) - F.col("event_time")).alias("rel_time"))


def _plain_cohorts(rows: DataFrame, keys: list[str], unit: str, t: str) -> tuple[DataFrame, DataFrame]:
    """(keys, plain): whether the closed form holds; (keys, unit, full, __yu, __xu): units
    with an untreated row at every time, and the means of those rows. Rows with a missing
    outcome or covariate leave the cohort to the iteration."""
    un = rows.filter("treat = 0")
    times = un.groupBy(*keys).agg(F.countDistinct(t).alias("__T"), F.max((F.col("Y").isNull() | F.col("__x").isNull()).cast("int")).alias("__gap"))
    units = un.groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("__n"), F.avg("Y").alias("__yu"), F.avg("__x").alias("__xu"))
    shape = materialize(units.join(times, keys).withColumn("full", F.col("__n") == F.col("__T")), "fe_units")
    plain = shape.groupBy(*keys).agg(F.sum(F.col("full").cast("int")).alias("__N"),
                                     F.sum((~F.col("full")).cast("int")).alias("__part"), F.max("__gap").alias("__gap"))
    plain = plain.select(*keys, "__N", ((F.col("__N") >= 1) & (F.col("__part") <= 1) & (F.col("__gap") == 0)).alias("plain"))
    return materialize(plain, "fe_plain"), shape.select(*keys, unit, "full", "__yu", "__xu")


def _closed(rows: DataFrame, plain: DataFrame, shape: DataFrame, keys: list[str], unit: str, t: str) -> DataFrame:
    r = rows.join(plain.filter("plain").drop("plain"), keys).join(shape, [*keys, unit], "left")
    donor, partial = F.col("full") & (F.col("treat") == 0), ~F.col("full") & (F.col("treat") == 0)
    m_t = materialize(r.filter(donor).groupBy(*keys, t).agg(F.avg("Y").alias("__my"), F.avg("__x").alias("__mx")), "fe_times")
    m = m_t.groupBy(*keys).agg(F.avg("__my").alias("__m_y"), F.avg("__mx").alias("__m_x"))
    r = r.join(m_t, [*keys, t], "left").join(m, keys)
    dev = r.filter(partial).select(*keys, t, (F.col("Y") - F.col("__my")).alias("__dy"), (F.col("__x") - F.col("__mx")).alias("__dx"))
    dev = materialize(dev, "fe_dev")                          # one unit per cohort
    delta = dev.groupBy(*keys).agg(F.avg("__dy").alias("__ay"), F.avg("__dx").alias("__ax"))
    e = dev.join(delta, keys).select(*keys, t, (F.col("__dy") - F.col("__ay")).alias("__ey"), (F.col("__dx") - F.col("__ax")).alias("__ex"))
    r = r.join(delta, keys, "left").join(e, [*keys, t], "left")
    share = F.col("__N") + 1

    def resid(v, own, mean, by_t, offset, e_t):
        own_effect = F.when(F.col("full"), F.col(own) - F.col(mean)).otherwise(F.col(offset))
        return F.col(v) - own_effect - F.col(by_t) - F.coalesce(F.col(e_t), F.lit(0.0)) / share

    r = r.withColumns({"__ry": resid("Y", "__yu", "__m_y", "__my", "__ay", "__ey"),
                       "__rx": resid("__x", "__xu", "__m_x", "__mx", "__ax", "__ex")})
    r = r.withColumn("__ident", F.col("full").isNotNull() & F.col("__my").isNotNull())
    return r.select(*keys, unit, t, *_OUT)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _plus(a: str | Column, k: Column, b: str | Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + k * y)


def _solve(units: DataFrame, right: DataFrame, keys: list[str], max_rounds: int, tol: float) -> tuple[DataFrame, int]:
    """Conjugate gradients for all cohorts: (keys, gy, gx, rounds) with arrays in the order of the
    cohort's times, and the number of rounds run.

    units  (keys, at array<int>): the positions of the times each unit is seen at
    right  (keys, n, by, bx): per time the number of rows and the two right sides
    """
    shapes = materialize(units.groupBy(*keys, "at").agg(F.count(F.lit(1)).cast("double").alias("__c")), "fe_shapes")
    zero = F.transform("n", lambda _: F.lit(0.0))
    state = right.withColumns({f"g{v}": zero for v in "yx"} | {f"r{v}": F.col(f"b{v}") for v in "yx"})
    state = state.withColumns({f"p{v}": F.zip_with(f"b{v}", "n", lambda b, n: b / n) for v in "yx"})
    state = state.withColumns({f"d{v}": _dot(f"r{v}", f"p{v}") for v in "yx"})
    state = state.withColumns({f"e{v}": F.col(f"d{v}") for v in "yx"}).withColumn("rounds", F.lit(0))
    state = materialize(state.drop("by", "bx"), "fe_state")
    size = state.agg(F.sum(F.size("n"))).first()[0] or 0
    near = F.broadcast if size <= BROADCAST_ENTRIES else (lambda df: df)
    far = lambda v: F.col(f"d{v}") > tol * tol * F.col(f"e{v}")
    for done in range(max_rounds + 1):
        if state.filter(far("y") | far("x")).limit(1).count() == 0:
            return state.select(*keys, "gy", "gx", "rounds"), done
        if done == max_rounds:
            break
        mean = lambda v: F.aggregate("at", F.lit(0.0), lambda acc, i: acc + F.element_at(f"p{v}", i)) / F.size("at")
        spread = shapes.join(near(state.select(*keys, "py", "px")), keys) \
            .select(*keys, "at", (mean("y") * F.col("__c")).alias("wy"), (mean("x") * F.col("__c")).alias("wx"))
        sums = spread.select(*keys, F.explode("at").alias("__i"), "wy", "wx").groupBy(*keys, "__i") \
            .agg(F.sum("wy").alias("wy"), F.sum("wx").alias("wx"))
        packed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "wy", "wx"))).alias("__w"))
        s = state.join(packed, keys).withColumn("rounds", F.when(far("y") | far("x"), F.lit(done + 1)).otherwise(F.col("rounds")))
        for v in "yx":
            w = F.col(f"__w.w{v}")
            # q = (left side applied to p); a cohort that has arrived takes no step
            s = s.withColumn("q", F.zip_with(F.zip_with("n", f"p{v}", lambda n, p: n * p), w, lambda a, b: a - b))
            step = F.when(far(v), F.coalesce(F.try_divide(F.col(f"d{v}"), _dot(f"p{v}", "q")), F.lit(0.0))).otherwise(F.lit(0.0))
            s = s.withColumn("a", step)
            s = s.withColumns({f"g{v}": _plus(f"g{v}", F.col("a"), f"p{v}"), f"r{v}": _plus(f"r{v}", -F.col("a"), "q")})
            s = s.withColumn("z", F.zip_with(f"r{v}", "n", lambda r, n: r / n)).withColumn("d", _dot(f"r{v}", "z"))
            turn = F.coalesce(F.try_divide(F.col("d"), F.col(f"d{v}")), F.lit(0.0))
            s = s.withColumns({f"p{v}": _plus("z", turn, f"p{v}"), f"d{v}": F.when(F.col("a") != 0, F.col("d")).otherwise(
                F.when(far(v), F.lit(0.0)).otherwise(F.col(f"d{v}")))}).drop("q", "a", "z", "d")
        state = materialize(s.drop("__w"), "fe_state")
    raise RuntimeError(f"the fixed effects have not converged after {max_rounds} rounds")


def _solved(rows: DataFrame, keys: list[str], unit: str, t: str, max_rounds: int, tol: float) -> tuple[DataFrame, DataFrame]:
    """The residual rows of `fe_counterfactual`, and the certificates: (keys, rounds, parts,
    residual_y, residual_x)."""
    fitted = rows.filter("treat = 0 AND Y IS NOT NULL AND __x IS NOT NULL").select(*keys, unit, t, "Y", "__x")
    times = fitted.groupBy(*keys).agg(F.sort_array(F.collect_set(t)).alias("__ts")) \
        .select(*keys, F.posexplode("__ts").alias("__i", t)).withColumn("__i", F.col("__i") + 1)
    times = materialize(times.join(time_parts(fitted, keys, unit, t), [*keys, t]), "fe_times")
    own = Window.partitionBy(*keys, unit)
    fitted = fitted.join(times, [*keys, t]).withColumns({"__dy": F.col("Y") - F.avg("Y").over(own),
                                                         "__dx": F.col("__x") - F.avg("__x").over(own)})
    fitted = materialize(fitted, "fe_fitted")
    units = fitted.groupBy(*keys, unit).agg(F.sort_array(F.collect_list("__i")).alias("at"))
    right = fitted.groupBy(*keys, "__i").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("__dy").alias("by"), F.sum("__dx").alias("bx"))
    right = right.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "n", "by", "bx"))).alias("__b")) \
        .select(*keys, *[F.col(f"__b.{c}").alias(c) for c in ("n", "by", "bx")])
    effects, _ = _solve(units, right, keys, max_rounds, tol)
    effects = materialize(effects, "fe_effects")
    g = times.join(effects, keys).select(*keys, t, F.col("part").alias("__pt"), F.element_at("gy", F.col("__i")).alias("__gy"),
                                         F.element_at("gx", F.col("__i")).alias("__gx"))
    g = materialize(g, "fe_g")
    a = fitted.join(g, [*keys, t]).groupBy(*keys, unit).agg(
        F.avg(F.col("Y") - F.col("__gy")).alias("__ay"), F.avg(F.col("__x") - F.col("__gx")).alias("__ax"), F.min("__pt").alias("__pu"))
    res = rows.join(g, [*keys, t], "left").join(a, [*keys, unit], "left")
    same = F.coalesce(F.col("__pu") == F.col("__pt"), F.lit(False))
    res = res.withColumns({"__ry": F.when(same, F.col("Y") - F.col("__ay") - F.col("__gy")),
                           "__rx": F.when(same, F.col("__x") - F.col("__ax") - F.col("__gx")), "__ident": same})
    res = materialize(res.select(*keys, unit, t, *_OUT), "fe_solved")
    done = F.col("treat") == 0
    left = res.filter(done & F.col("__ry").isNotNull() & F.col("__rx").isNotNull()).groupBy(*keys, t) \
        .agg(F.abs(F.avg("__ry")).alias("__my"), F.abs(F.avg("__rx")).alias("__mx"), F.max(F.abs("Y")).alias("__sy"), F.max(F.abs("__x")).alias("__sx"))
    relative = lambda m, s: F.coalesce(F.try_divide(F.max(m), F.max(s)), F.lit(0.0))
    report = left.groupBy(*keys).agg(relative("__my", "__sy").alias("residual_y"), relative("__mx", "__sx").alias("residual_x"))
    parts = times.groupBy(*keys).agg(F.countDistinct("part").alias("parts"))
    report = materialize(report.join(effects.select(*keys, "rounds"), keys).join(parts, keys), "fe_report")
    worst = report.agg(F.max(F.greatest("residual_y", "residual_x"))).first()[0]
    if worst is not None and not worst <= CERTIFIED:
        raise RuntimeError(f"the fixed effects have not converged: a time mean of the residuals is {worst:.3g} of the largest value")
    return res, report.select(*keys, "rounds", "parts", "residual_y", "residual_x")


def fe_certificates(cohorts: DataFrame, y: str = "Y", cov: str = "mob", treat: str = "treat", unit: str = "u", t: str = "t",
                    keys: Sequence[str] = tuple(COHORT_KEYS), max_rounds: int = 1000, tol: float = 1e-12) -> DataFrame:
    """Per cohort, solved by conjugate gradients: the rounds it took, the connected parts of its
    times, and the largest time mean of the residuals of outcome and covariate, relative to
    their largest value."""
    rows = cohorts.select(*keys, unit, t, F.col(y).cast("double").alias("Y"), F.col(treat).cast("int").alias("treat"),
                          "event_time", F.col(cov).cast("double").alias("__x"))
    return _solved(materialize(rows, "fe_rows"), list(keys), unit, t, max_rounds, tol)[1]


def att_by_time(fe_rows: DataFrame, keys: Sequence[str] = tuple(COHORT_KEYS)) -> DataFrame:
    """Average effect on the treated rows by time relative to the event."""
    return (fe_rows.filter(F.col("treat") == 1).groupBy(*keys, "rel_time")
            .agg(F.avg("effect").alias("att"), F.count("effect").alias("n_treated"), F.first("beta").alias("beta")))
