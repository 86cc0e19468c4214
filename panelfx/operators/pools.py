"""Cohorts without copies of their donors (E5, Y7 and Y11 where treated units grow with the data).

The donors of a cohort depend on its exposure and outcome alone. They are stored once for
each of those, as a pool; a cohort is a reference to its pool plus one exclusion, its own treated unit
where that is a donor too. What the estimators need of the donors are sums per pool and time, and a
cohort's own are those less the excluded unit's, so rows stay linear in the panel however many
units are treated:

* donor means: (pool sum - own value) / (members - 1);
* the two-way fit in closed form (see ``fe``): the pool's doubly demeaned cross products Q are shared;
  without unit k they are Q - N / (N - 1) sum_t q_kt q_kt', with its own pre-event rows the cohort's
  slope is (Qxy + N / (N + 1) sum_t e_xt e_yt) / (Qxx + N / (N + 1) sum_t e_xt^2);
* the two-way fit of ragged pools (`fe_ragged`): the equations of the time effects (see ``fe``) are made of
  sums over units, so a cohort's are the pool's, less the excluded unit's, plus its treated unit's;
* placebo effects: a donor's gap from the other donors' mean is the same in every cohort of the pool,
  its pre-event RMSPE a running sum read at the event time; treated effects are then placed among
  the placebos of their event time and time by rank (``ranks``), not by pairing.

A cohort whose treated unit is one of the pool's donors has placebo gaps of its own (each leaves
that unit out); only such cohorts are expanded, by ``cohort.build_cohorts``' own rows.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from ..spec import PanelSpec
from . import infer
from .cohort import COHORT_KEYS, CohortRules, _pick, _unit_time, rule_columns, unit_facts
from .events import first_exposure
from .fe import CERTIFIED
from .ranks import rank_counts

try:  # ship this module's code with the task, so workers need no installed copy
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # older pickler: rely on the package being on the executors' path
    pass

POOL = ["exposure", "outcome"]


@dataclass(frozen=True)
class Pools:
    """rows     exposure, outcome, u, t, Y, x: the donors, once per exposure and outcome
    cohorts  cohort keys, event_time, in_pool (the treated unit is one of the pool's donors)
    treated  cohort keys, event_time, in_pool, t, Y, x: the treated units' own rows
    """

    rows: DataFrame
    cohorts: DataFrame
    treated: DataFrame


def build_pools(panel: DataFrame, spec: PanelSpec, grid: DataFrame, outcomes: Sequence[str], exposure_flags: Mapping[str, str],
                rules: CohortRules = CohortRules(), events: DataFrame | None = None, event_shift: int = 0, keep_lost: bool = False) -> Pools:
    """The cohorts of ``cohort.build_cohorts`` (same arguments and rules), factorised. Cohorts whose
    treated unit fails a rule are left out, as they have no effect to estimate; with `keep_lost` they
    stay, without rows of a treated unit."""
    u, t = _unit_time(spec)
    cov, flags = rules.covariate, dict(exposure_flags)
    base, ystats, ustats, n_times = unit_facts(panel, spec, outcomes, flags, rules)
    base = base.select(F.col(u).alias("u"), F.col(t).alias("t"), "outcome", "Y", (F.col(cov) if cov else F.lit(0.0)).cast("double").alias("x"))
    facts = ystats.join(ustats, u).withColumn("exposure", F.explode(F.array(*[F.lit(n) for n in flags])))
    ok, donor_ok = rule_columns(rules, _pick(F.col("exposure"), {n: F.col(f"__share_{n}") for n in flags}), n_times)
    facts = materialize(facts.select(*POOL, F.col(u).alias("u"), ok.alias("ok"), (ok & donor_ok).alias("donor")).filter("ok"), "facts")
    members = facts.filter("donor").select(*POOL, "u")
    if events is None:
        events = first_exposure(panel, spec, flags, "definition", "event_time")
    ev = events.select(F.col(u).alias("treated_unit"), F.col("definition").alias("exposure"),
                       (F.col("event_time") + F.lit(event_shift)).alias("event_time"))
    kept = grid.dropna(subset=COHORT_KEYS).join(facts.withColumnRenamed("u", "treated_unit"), [*POOL, "treated_unit"], "left" if keep_lost else "inner")
    cohorts = kept.join(ev, ["treated_unit", "exposure"], "left").select(*COHORT_KEYS, "event_time", F.col("donor").alias("in_pool"))
    cohorts = materialize(cohorts, "cohorts")
    rows = materialize(members.join(base, ["u", "outcome"]).select(*POOL, "u", "t", "Y", "x"), "pool")
    treated = materialize(cohorts.filter("in_pool IS NOT NULL").join(base.withColumnRenamed("u", "treated_unit"), ["treated_unit", "outcome"])
                          .select(*COHORT_KEYS, "event_time", "in_pool", "t", "Y", "x"), "treated")
    return Pools(rows, cohorts.fillna(False, ["in_pool"]), treated)


def _sums(pools: Pools) -> DataFrame:
    """(exposure, outcome, t, n, sy, sx): members and sums of a pool by time."""
    return pools.rows.groupBy(*POOL, "t").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("Y").alias("sy"), F.sum("x").alias("sx"))


def fe_att(pools: Pools) -> DataFrame:
    """Y11 on pools: (cohort keys, rel_time, att, n_treated, beta) as ``fe.att_by_time`` gives on the
    expanded cohorts. Needs balanced pools without missing values, as the default rules make them."""
    t_of = pools.rows.groupBy(*POOL).agg(F.countDistinct("t").alias("T"))
    units = pools.rows.groupBy(*POOL, "u").agg(F.count("Y").alias("ny"), F.count("x").alias("nx"), F.countDistinct("t").alias("nt"))
    if units.join(t_of, POOL).filter("ny <> T OR nx <> T OR nt <> T").limit(1).count():
        raise ValueError("a pool is not balanced; use fe.fe_counterfactual on its cohorts")
    by_t = materialize(_sums(pools), "pool_sums")
    own, all_ = Window.partitionBy(*POOL, "u"), [F.avg("my").alias("gy"), F.avg("mx").alias("gx")]
    means = by_t.select(*POOL, "t", (F.col("sy") / F.col("n")).alias("my"), (F.col("sx") / F.col("n")).alias("mx"))
    means = materialize(means.join(means.groupBy(*POOL).agg(*all_), POOL), "pool_means")
    q = pools.rows.withColumns({"yu": F.avg("Y").over(own), "xu": F.avg("x").over(own)}).join(means, [*POOL, "t"])
    q = materialize(q.select(*POOL, "u", "t", (F.col("Y") - F.col("yu") - F.col("my") + F.col("gy")).alias("qy"),
                             (F.col("x") - F.col("xu") - F.col("mx") + F.col("gx")).alias("qx")), "pool_q")
    cross = q.groupBy(*POOL).agg(F.sum(F.col("qx") * F.col("qy")).alias("qxy"), F.sum(F.col("qx") * F.col("qx")).alias("qxx"))
    # the excluded unit's share of them
    out = pools.cohorts.filter("in_pool").join(q.withColumnRenamed("u", "treated_unit"), [*POOL, "treated_unit"]) \
        .groupBy(*COHORT_KEYS).agg(F.sum(F.col("qx") * F.col("qy")).alias("oxy"), F.sum(F.col("qx") * F.col("qx")).alias("oxx"))
    tr = pools.treated.join(by_t, [*POOL, "t"])
    less = F.when(F.col("in_pool"), 1.0).otherwise(0.0)
    left = F.col("n") - less
    tr = tr.withColumns({"N": left, "dy": F.col("Y") - F.try_divide(F.col("sy") - less * F.col("Y"), left),
                         "dx": F.col("x") - F.try_divide(F.col("sx") - less * F.col("x"), left)})
    tr = materialize(tr.withColumn("post", F.coalesce(F.col("t") >= F.col("event_time"), F.lit(False))), "treated_gaps")
    pre = tr.filter("NOT post").groupBy(*COHORT_KEYS).agg(F.avg("dy").alias("ay"), F.avg("dx").alias("ax"))
    tr = tr.join(pre, COHORT_KEYS, "left")
    ey, ex = F.col("dy") - F.col("ay"), F.col("dx") - F.col("ax")
    e = tr.groupBy(*COHORT_KEYS).agg(F.coalesce(F.sum(F.when(~F.col("post"), ex * ey)), F.lit(0.0)).alias("exy"),
                                     F.coalesce(F.sum(F.when(~F.col("post"), ex * ex)), F.lit(0.0)).alias("exx"), F.max("N").alias("N"))
    e = e.join(cross, POOL).join(out, COHORT_KEYS, "left")
    n = F.col("N")
    slope = lambda c: F.col(f"q{c}") - F.coalesce((n + 1) / n * F.col(f"o{c}"), F.lit(0.0)) + n / (n + 1) * F.col(f"e{c}")
    beta = e.filter("N > 0").select(*COHORT_KEYS, F.try_divide(slope("xy"), slope("xx")).alias("beta"))
    eff = ey - F.coalesce("beta", F.lit(0.0)) * ex
    return tr.filter("post").join(beta, COHORT_KEYS, "left").groupBy(*COHORT_KEYS, (F.col("t") - F.col("event_time")).alias("rel_time")) \
        .agg(F.avg(eff).alias("att"), F.count(eff).alias("n_treated"), F.first("beta").alias("beta"))


def _fit_ragged(row, max_rounds: int, tol: float) -> dict:
    """The fit of one cohort (a row of the joined tables of `fe_ragged`) by conjugate gradients."""
    ts = np.asarray(row.ts)
    size = len(ts)
    n, b, scale = np.zeros(size), {v: np.zeros(size) for v in "yx"}, {v: 0.0 for v in "yx"}
    cross, both, mean = {"xy": 0.0, "xx": 0.0}, np.zeros((size, size)), np.zeros((size, size))
    if row.at is not None:
        at = np.asarray(row.at)
        n[at] = row.n
        for v, sums, high in (("y", row.by, row.hy), ("x", row.bx, row.hx)):
            b[v][at], scale[v] = sums, max(high)
        cross = {"xy": row.sxy, "xx": row.sxx}
        both[np.asarray(row.a), np.asarray(row.b)] = row.c
        mean[np.asarray(row.a), np.asarray(row.b)] = row.w

    def add(cells, sign):
        """One unit's share of the sums: its times, outcomes and covariates."""
        if not cells:
            return
        at = np.array([c["i"] for c in cells])
        val = {"y": np.array([c["Y"] for c in cells]), "x": np.array([c["x"] for c in cells])}
        dev = {v: val[v] - val[v].mean() for v in "yx"}
        n[at] += sign
        both[np.ix_(at, at)] += sign
        mean[np.ix_(at, at)] += sign / len(at)
        for v in "yx":
            b[v][at] += sign * dev[v]
            cross["x" + v] += sign * float(dev["x"] @ dev[v])
            if sign > 0:
                scale[v] = max(scale[v], float(np.abs(val[v]).max()))

    own = [c.asDict() if hasattr(c, "asDict") else c for c in (row.own if row.own is not None else [])]
    before = [c for c in own if not c["post"]]
    add([c.asDict() if hasattr(c, "asDict") else c for c in (row.out if row.out is not None else [])], -1)
    add(before, 1)
    live = n > 0
    if not live.any():
        return None
    # connected parts: a time's part is the least time it reaches
    part = np.arange(size)
    near = both > 0
    while True:
        low = np.where(near, part[None, :], size).min(axis=1, initial=size)
        low = np.minimum(part, low)
        if (low == part).all():
            break
        part = low
    left = lambda g: n * g - mean @ g
    rounds, g = 0, {}
    for v in "yx":
        x, r = np.zeros(size), np.where(live, b[v], 0.0)
        z = np.divide(r, n, out=np.zeros(size), where=live)
        p, d = z.copy(), float(r @ z)
        goal, done = tol * tol * d, 0
        while d > goal:
            if done == max_rounds:
                raise RuntimeError(f"the fixed effects have not converged after {max_rounds} rounds")
            done += 1
            q = left(p)
            step = float(p @ q)
            if step == 0:
                break
            x, r = x + d / step * p, r - d / step * q
            z = np.divide(r, n, out=np.zeros(size), where=live)
            new = float(r @ z)
            p, d = z + new / d * p, new
        g[v], rounds = x, max(rounds, done)
    certified = {}
    for v in "yx":                                   # time means of the residuals, anew from the sums
        means = np.abs((b[v] - left(g[v]))[live] / n[live])
        certified[v] = float(means.max() / scale[v]) if scale[v] > 0 else 0.0
    worst = max(certified.values())
    if not worst <= CERTIFIED:
        raise RuntimeError(f"the fixed effects have not converged: a time mean of the residuals is {worst:.3g} of the largest value")
    xy = cross["xy"] - g["y"] @ b["x"] - g["x"] @ b["y"] + g["y"] @ left(g["x"])
    xx = cross["xx"] - 2 * (g["x"] @ b["x"]) + g["x"] @ left(g["x"])
    beta = float(xy / xx) if xx > 0 else None
    effects = []
    a = {v: np.mean([c[k] - g[v][c["i"]] for c in before]) if before else None for v, k in (("y", "Y"), ("x", "x"))}
    for c in own:
        if c["post"]:
            i = c["i"]
            same = bool(before) and live[i] and part[i] == part[before[0]["i"]]
            e = (c["Y"] - a["y"] - g["y"][i]) - (beta or 0.0) * (c["x"] - a["x"] - g["x"][i]) if same else None
            effects.append({"t": int(ts[i]), "effect": e if e is None else float(e)})
    return {"rounds": rounds, "parts": len(set(part[live].tolist())), "residual_y": certified["y"], "residual_x": certified["x"],
            "beta": beta, "effects": effects}


def fe_ragged(pools: Pools, max_rounds: int = 1000, tol: float = 1e-12) -> DataFrame:
    """Y11 on pools whose units are seen at some times only: (cohort keys, event_time, rounds, parts, residual_y,
    residual_x, beta, effects array of (t, effect)), what ``fe`` finds on the expanded cohorts by conjugate
    gradients. A pool is the number of units at each time, the sums of their deviations, and by pair of
    times the number of units seen at both and the sum of one over their times: bounded by the calendar. A
    cohort is solved from these sums in one row. Needs one row per unit and time, without missing values,
    as the default rules and `drop_gaps=False` make them."""
    ok = "t IS NOT NULL"
    rows, treated = pools.rows.filter(ok), pools.treated.filter(ok)
    for df, by in ((rows, [*POOL, "u", "t"]), (treated, [*COHORT_KEYS, "t"])):
        odd = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("Y").alias("ny"), F.count("x").alias("nx"))
        if odd.filter("n <> 1 OR ny <> 1 OR nx <> 1").limit(1).count():
            raise ValueError("a unit has missing values or a time twice; use fe.fe_counterfactual on its cohorts")
    times = rows.select(*POOL, "t").unionByName(treated.select(*POOL, "t")).groupBy(*POOL).agg(F.sort_array(F.collect_set("t")).alias("ts"))
    times = materialize(times, "fe_times")
    place = times.select(*POOL, F.posexplode("ts").alias("i", "t"))
    own = Window.partitionBy(*POOL, "u")
    p = rows.join(F.broadcast(place), [*POOL, "t"]).withColumns({"dy": F.col("Y") - F.avg("Y").over(own), "dx": F.col("x") - F.avg("x").over(own)})
    p = materialize(p.select(*POOL, "u", "i", "Y", "x", "dy", "dx"), "fe_pool")
    by_t = p.groupBy(*POOL, "i").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("dy").alias("by"), F.sum("dx").alias("bx"),
                                     F.max(F.abs("Y")).alias("hy"), F.max(F.abs("x")).alias("hx"))
    sums = by_t.groupBy(*POOL).agg(F.array_sort(F.collect_list(F.struct("i", "n", "by", "bx", "hy", "hx"))).alias("s")) \
        .select(*POOL, F.col("s.i").alias("at"), *[F.col(f"s.{c}").alias(c) for c in ("n", "by", "bx", "hy", "hx")])
    cross = p.groupBy(*POOL).agg(F.sum(F.col("dx") * F.col("dy")).alias("sxy"), F.sum(F.col("dx") * F.col("dx")).alias("sxx"))
    shapes = p.groupBy(*POOL, "u").agg(F.sort_array(F.collect_list("i")).alias("at")).groupBy(*POOL, "at").agg(F.count(F.lit(1)).cast("double").alias("c"))
    pairs = shapes.select(*POOL, "c", (F.col("c") / F.size("at")).alias("w"), "at", F.explode("at").alias("a")) \
        .select(*POOL, "c", "w", "a", F.explode("at").alias("b")).groupBy(*POOL, "a", "b").agg(F.sum("c").alias("c"), F.sum("w").alias("w"))
    pairs = pairs.groupBy(*POOL).agg(F.collect_list(F.struct("a", "b", "c", "w")).alias("m")).select(*POOL, *[F.col(f"m.{c}").alias(c) for c in "abcw"])
    pool = materialize(times.join(sums, POOL, "left").join(cross, POOL, "left").join(pairs, POOL, "left"), "fe_sums")

    cell = F.struct("i", "Y", "x")
    out = pools.cohorts.filter("in_pool").select(*COHORT_KEYS).join(p.withColumnRenamed("u", "treated_unit"), COHORT_KEYS) \
        .groupBy(*COHORT_KEYS).agg(F.collect_list(cell).alias("out"))
    post = F.coalesce(F.col("t") >= F.col("event_time"), F.lit(False)).alias("post")
    mine = treated.join(F.broadcast(place), [*POOL, "t"]).groupBy(*COHORT_KEYS).agg(F.collect_list(F.struct("i", "Y", "x", post)).alias("own"))
    cohorts = pools.cohorts.select(*COHORT_KEYS, "event_time").join(out, COHORT_KEYS, "left").join(mine, COHORT_KEYS, "left")
    cohorts = cohorts.repartition(int(cohorts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *COHORT_KEYS).join(F.broadcast(pool), POOL)
    kinds = pools.cohorts.schema
    schema = T.StructType([*[kinds[k] for k in (*COHORT_KEYS, "event_time")], T.StructField("rounds", T.IntegerType()), T.StructField("parts", T.LongType()),
                           *[T.StructField(k, T.DoubleType()) for k in ("residual_y", "residual_x", "beta")],
                           T.StructField("effects", T.ArrayType(T.StructType([T.StructField("t", T.IntegerType()), T.StructField("effect", T.DoubleType())])))])
    names = schema.fieldNames()

    def run(frames):
        for frame in frames:
            got = []
            for row in frame.itertuples(index=False):
                fit = _fit_ragged(row, max_rounds, tol)
                if fit is not None:
                    event = None if pd.isna(row.event_time) else int(row.event_time)
                    got.append({**{k: getattr(row, k) for k in COHORT_KEYS}, "event_time": event, **fit})
            if got:
                table = pd.DataFrame(got, columns=names)
                table["event_time"] = table["event_time"].astype("Int64")
                yield table

    return cohorts.mapInPandas(run, schema)


def att_of(fits: DataFrame) -> DataFrame:
    """(cohort keys, rel_time, att, n_treated, beta) of `fe_ragged`, as ``fe.att_by_time`` gives."""
    e = fits.select(*COHORT_KEYS, "beta", "event_time", F.explode("effects").alias("e"))
    return e.groupBy(*COHORT_KEYS, (F.col("e.t") - F.col("event_time")).alias("rel_time")).agg(
        F.avg("e.effect").alias("att"), F.count("e.effect").alias("n_treated"), F.first("beta").alias("beta"))


def placebo_pvalues(pools: Pools, standardize: bool = True) -> DataFrame:
    """Y7 with donor-mean weights on pools: (cohort keys, t, pval, n_placebos, lead) as
    ``infer.placebo_pvalues`` gives on the expanded cohorts."""
    apart, shared = pools.cohorts.filter("in_pool"), pools.cohorts.filter("NOT in_pool")
    by_t = materialize(_sums(pools), "pool_sums")
    at = F.col("event_time")

    # the pool's placebos: every donor against the mean of the others
    gap = F.col("Y") - F.try_divide(F.col("sy") - F.col("Y"), F.col("n") - 1)
    a = pools.rows.join(by_t, [*POOL, "t"]).select(*POOL, "u", "t", gap.alias("gap"))
    events = shared.filter(at.isNotNull()).select(*POOL, "event_time").distinct()
    # squared gaps before each time, by a running sum; read at the event times
    before = Window.partitionBy(*POOL, "u").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    a = materialize(a.withColumn("pre", F.sqrt(F.avg(F.col("gap") * F.col("gap")).over(before))), "placebo_gaps")
    pre = a.join(events.select(*POOL, at.alias("t")), [*POOL, "t"]).select(*POOL, "u", F.col("t").alias("event_time"), "pre")
    late = a.drop("pre").join(pre, [*POOL, "u"]).filter(F.col("t") >= at)
    e = F.try_divide(F.col("gap"), F.col("pre")) if standardize else F.col("gap")
    points = late.select(*POOL, "event_time", "t", e.alias("e"))

    tr = pools.treated.filter("NOT in_pool").join(by_t, [*POOL, "t"])
    tr = tr.withColumn("gap", F.col("Y") - F.try_divide(F.col("sy"), F.col("n")))
    own = tr.filter(F.col("t") < at).groupBy(*COHORT_KEYS).agg(F.sqrt(F.avg(F.col("gap") * F.col("gap"))).alias("pre"))
    tr = tr.filter(F.col("t") >= at).join(own, COHORT_KEYS, "left")
    tr = materialize(tr.select(*COHORT_KEYS, "event_time", "t", e.alias("e")), "treated_effects")
    r = rank_counts(points, tr, [*POOL, "event_time", "t"], "e")
    hits = F.when(F.col("e") >= 0, F.col("n_points") - F.col("n_below")).otherwise(F.col("n_upto"))
    out = r.select(*COHORT_KEYS, "t", F.try_divide(hits.cast("double"), F.col("n_points").cast("double")).alias("pval"),
                   F.col("n_points").alias("n_placebos"), (F.col("t") - at).alias("lead"))
    if not apart.limit(1).count():
        return out
    # cohorts that leave one of the pool's donors out have placebo gaps of their own
    pairs = apart.join(pools.rows, POOL).filter("u <> treated_unit").select(*COHORT_KEYS, "u", "t", "Y", F.lit(0).alias("treated"), "event_time")
    mine = pools.treated.filter("in_pool").select(*COHORT_KEYS, F.col("treated_unit").alias("u"), "t", "Y", F.lit(1).alias("treated"), "event_time")
    gaps = materialize(infer.synth_series(materialize(pairs.unionByName(mine), "apart")), "apart_gaps")
    return out.unionByName(infer.placebo_pvalues(gaps, standardize=standardize))
