"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Integer sums are cast back to BIGINT (DuckDB widens them), money is summed as
DECIMAL(18,2) and converted to DOUBLE once, and ratios divide once, so both engines
produce bit-identical values regardless of summation order.
"""

from __future__ import annotations

# ------------------------------------------------------------------ shared CTEs

PANEL = """
o_ AS (
  SELECT CAST(c_nationkey AS INTEGER) AS u, CAST(date_trunc('week', o_orderdate) AS DATE) AS wk,
         CAST(count(*) AS BIGINT) AS n,
         CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS k,
         CAST(sum(CASE WHEN o_orderpriority = '5-LOW' THEN -1 ELSE 1 END) AS BIGINT) AS delta,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS mob
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
p0_ AS (SELECT *, CAST(datediff('day', DATE '1994-12-26', wk) // 7 AS INTEGER) AS t FROM o_),
panel AS (
  SELECT *, CASE WHEN u % 5 = 3 AND t >= 200 + u AND t < 205 + u THEN CAST(60.0 + (t % 5) * 10 AS DOUBLE)
                 ELSE CAST((n * 7) % 40 AS DOUBLE) END AS dose
  FROM p0_)"""

CUM = """
cum_ AS (SELECT u, t, delta,
                CAST(sum(delta) OVER (PARTITION BY u ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                     AS BIGINT) AS cum
         FROM panel)"""

W = "WINDOW w AS (PARTITION BY u ORDER BY t)"


def ieee(num: str, den: str) -> str:
    n, d = f"CAST({num} AS DOUBLE)", f"CAST({den} AS DOUBLE)"
    return (f"(CASE WHEN {d} = 0 THEN (CASE WHEN {n} = 0 THEN CAST('NaN' AS DOUBLE) "
            f"WHEN {n} > 0 THEN CAST('Infinity' AS DOUBLE) WHEN {n} < 0 THEN CAST('-Infinity' AS DOUBLE) END) "
            f"ELSE {n} / {d} END)")


def nulldiv(num: str, den: str) -> str:
    return f"(CASE WHEN CAST({den} AS DOUBLE) = 0 THEN NULL ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END)"


def roll(c: str, n: int) -> str:
    fr = f"(PARTITION BY u ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({c}) OVER {fr} = {n} THEN CAST(sum({c}) OVER {fr} AS BIGINT) END)"


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


# ------------------------------------------------------------------ step 1: series

SQL: dict[str, str] = {}

SQL["test_panel"] = with_(PANEL) + "SELECT * FROM panel"

SQL["smoothed_ratio"] = with_(PANEL, f"""
r_ AS (SELECT u, t, {roll('k', 7)} AS k7, {roll('n', 7)} AS n7 FROM panel),
l_ AS (SELECT *, lag(n7, 7) OVER w AS n7_lag7 FROM r_ {W})""") + f"""
SELECT u, t, k7, n7, n7_lag7, {ieee('k7', 'n7_lag7')} AS ratio7_lag7, {ieee('k7', 'n7')} AS ratio7_same FROM l_"""

SQL["decumulate_total"] = with_(PANEL, CUM) + f"""
SELECT u, t, cum, CASE WHEN row_number() OVER w = 1 THEN cum ELSE cum - lag(cum) OVER w END AS step FROM cum_ {W}"""

SQL["decumulate_zero"] = with_(PANEL, CUM) + f"""
SELECT u, t, cum, CASE WHEN row_number() OVER w = 1 THEN cum - cum ELSE cum - lag(cum) OVER w END AS step
FROM cum_ {W}"""

SQL["repair_negative"] = with_(PANEL, CUM, f"""
s_ AS (SELECT u, t, CASE WHEN row_number() OVER w = 1 THEN cum - cum ELSE cum - lag(cum) OVER w END AS step
       FROM cum_ {W})""") + f"""
SELECT u, t, step,
       CASE WHEN step >= 0 THEN step END AS step_null,
       CASE WHEN step < 0 THEN lag(step) OVER w ELSE step END AS step_prev,
       CASE WHEN step < 0 THEN last(CASE WHEN step >= 0 THEN step END IGNORE NULLS)
            OVER (PARTITION BY u ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            ELSE step END AS step_last_good
FROM s_ {W}"""


def _lagmean(c: str) -> str:
    fr = "(PARTITION BY u ORDER BY t ROWS BETWEEN 14 PRECEDING AND 8 PRECEDING)"
    return f"(CASE WHEN count({c}) OVER {fr} = 7 THEN CAST(sum({c}) OVER {fr} AS DOUBLE) / 7.0 END)"


SQL["lagged_measures"] = with_(PANEL) + f"""
SELECT u, t, n, lag(n, 14) OVER w AS n_lag14, {_lagmean('n')} AS n_avg8_14, {_lagmean('k')} AS k_avg8_14
FROM panel {W}"""

SQL["rolling_sums"] = with_(PANEL) + f"""
SELECT u, t, {roll('n', 7)} AS n_roll7, {roll('k', 7)} AS k_roll7, {roll('n', 14)} AS n_roll14,
       {roll('k', 14)} AS k_roll14 FROM panel"""


# ------------------------------------------------------------------ more shared CTEs

CPANEL = """
units_ AS (SELECT DISTINCT u FROM p0_),
b_ AS (SELECT min(t) AS lo, max(t) AS hi FROM p0_),
g0_ AS (SELECT u, unnest(generate_series(lo, hi)) AS t FROM units_, b_),
grid_ AS (SELECT u, CAST(t AS INTEGER) AS t FROM g0_),
cpn_ AS (SELECT g.u, g.t, DATE '1994-12-26' + CAST(7 * g.t AS INTEGER) AS wk, p.n, p.k, p.delta, p.mob,
                CASE WHEN p.u IS NULL THEN 1 ELSE 0 END AS added
         FROM grid_ g LEFT JOIN p0_ p ON g.u = p.u AND g.t = p.t),
cp0_ AS (SELECT u, t, wk, coalesce(n, 0) AS n, coalesce(k, 0) AS k, delta, coalesce(mob, 0.0) AS mob, added FROM cpn_),
cpanel AS (
  SELECT *, CASE WHEN u % 5 = 3 AND t >= 200 + u AND t < 205 + u THEN CAST(60.0 + (t % 5) * 10 AS DOUBLE)
                 ELSE CAST((n * 7) % 40 AS DOUBLE) END AS dose
  FROM cp0_)"""

SMOOTH = f"""
r_ AS (SELECT u, t, k, n, {roll('k', 7)} AS k7, {roll('n', 7)} AS n7 FROM panel),
l_ AS (SELECT *, lag(n7, 7) OVER w AS n7_lag7 FROM r_ {W})"""

LAB = """
lab_ AS (SELECT CAST(n_nationkey AS INTEGER) AS u, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""

SHIP = """
s_ AS (
  SELECT CAST(s_nationkey AS INTEGER) AS u, CAST(date_trunc('week', l_shipdate) AS DATE) AS wk,
         CAST(count(*) AS BIGINT) AS n,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS k,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS mob
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
ship AS (SELECT *, CAST(datediff('day', DATE '1994-12-26', wk) // 7 AS INTEGER) AS t FROM s_)"""

STEPS = f"""
st_ AS (SELECT u, t, delta, cum,
               CASE WHEN row_number() OVER w = 1 THEN cum - cum ELSE cum - lag(cum) OVER w END AS step
        FROM cum_ {W}),
sn_ AS (SELECT *, CASE WHEN step >= 0 THEN step END AS step_null FROM st_)"""

CSMOOTH = f"""
cr_ AS (SELECT u, t, k, n, {roll('k', 7)} AS k7, {roll('n', 7)} AS n7 FROM cpanel),
cl_ AS (SELECT *, lag(n7, 7) OVER w AS n7_lag7 FROM cr_ {W})"""

RATIOS = f"""
ra_ AS (SELECT u, t, k7, n7, n7_lag7, {ieee('k7', 'n7_lag7')} AS r_lag, {ieee('k7', 'n7')} AS r_same FROM cl_)"""

EXPOSURES = {"p50": 50, "p70": 70, "p90": 90}


def flag(c: str, cut) -> str:
    return f"(CASE WHEN isnan({c}) THEN NULL WHEN {c} >= {cut} THEN 1 WHEN {c} < {cut} THEN 0 END)"


FLAGGED = """
fl_ AS (SELECT u, t, dose, """ + ", ".join(f"{flag('dose', c)} AS {n}" for n, c in EXPOSURES.items()) + """ FROM cpanel),
ev_ AS (SELECT u, """ + ", ".join(f"min(CASE WHEN {n} = 1 THEN t END) AS {n}" for n in EXPOSURES) + """ FROM fl_ GROUP BY u)"""

# ------------------------------------------------------------------ step 2: panel

SQL["wide_to_long"] = with_(PANEL, CUM, """
us_ AS (SELECT DISTINCT u FROM cum_), ts_ AS (SELECT DISTINCT t FROM cum_)""") + """
SELECT us_.u, ts_.t + 5 AS day, c.cum, DATE '1994-12-26' + CAST(7 * ts_.t AS INTEGER) AS wk
FROM us_ CROSS JOIN ts_ LEFT JOIN cum_ c ON c.u = us_.u AND c.t = ts_.t"""

SQL["panel_duplicates"] = """
SELECT o_custkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS wk, count(*) AS n_rows
FROM orders GROUP BY 1, 2 HAVING count(*) > 1"""

SQL["recode_names"] = with_(PANEL, LAB) + """
SELECT p.u, p.t, l.r_name,
       CASE l.r_name WHEN 'AFRICA' THEN 'AF' WHEN 'AMERICA' THEN 'AM' WHEN 'ASIA' THEN 'AS' WHEN 'EUROPE' THEN 'EU'
            ELSE l.r_name END AS region
FROM panel p JOIN lab_ l ON p.u = l.u"""

_D8 = "CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS BIGINT)"
SQL["parse_dates"] = f"""
SELECT o_orderkey, {_D8} AS d8, CAST(try_strptime(CAST({_D8} AS VARCHAR), '%Y%m%d') AS DATE) AS parsed FROM orders"""

SQL["iso_weeks"] = with_(PANEL) + "SELECT u, t, CAST(week(wk) AS INTEGER) AS week, t - 200 AS rel FROM panel"

SQL["exposure_flags"] = with_(PANEL) + "SELECT u, t, " + ", ".join(
    f"{flag('dose', c)} AS {n}" for n, c in EXPOSURES.items()) + \
    ", CASE WHEN delta < 0 THEN 1 ELSE 0 END AS neg FROM panel"

_ELIG = "('NATION_3', 'NATION_8', 'NATION_13', 'NATION_18', 'NATION_23')"
SQL["unit_labels"] = with_(PANEL, LAB, """
pl_ AS (SELECT p.u, p.t, l.n_name, l.r_name FROM panel p JOIN lab_ l ON p.u = l.u)""") + f"""
SELECT u, t, n_name, r_name, replace(replace(n_name || r_name, ' ', ''), '_', '') AS label,
       CASE WHEN n_name IN {_ELIG} AND r_name = 'EUROPE' THEN 'Yes' ELSE 'No' END AS eligible,
       CAST(dense_rank() OVER (ORDER BY n_name, r_name) AS INTEGER) AS id
FROM pl_"""

SQL["melt_outcomes"] = with_(PANEL, SMOOTH, f"""
m_ AS (SELECT u, t, {ieee('k7', 'n7_lag7')} AS ratio7_lag7, {ieee('k7', 'n7')} AS ratio7_same FROM l_)""") + """
SELECT u, t, 'ratio7_lag7' AS outcome, ratio7_lag7 * 1000.0 AS Y FROM m_
UNION ALL SELECT u, t, 'ratio7_same' AS outcome, ratio7_same * 1000.0 AS Y FROM m_"""

SQL["complete_panel"] = with_(PANEL, CPANEL) + "SELECT u, t, wk, n, k, delta, mob, dose, added FROM cpanel"

SQL["interpolate_gaps"] = with_(PANEL, CPANEL) + f"""
SELECT u, t, coalesce(n, (lag(n) OVER w + lead(n) OVER w) / 2.0) AS n,
       coalesce(mob, (lag(mob) OVER w + lead(mob) OVER w) / 2.0) AS mob
FROM cpn_ {W}"""

SQL["panel_gaps"] = with_(PANEL, CPANEL) + "SELECT u, t FROM grid_ EXCEPT ALL SELECT u, t FROM p0_"

# ------------------------------------------------------------------ step 3: merges

_L = "(SELECT u, t, wk, n, k, delta, mob FROM p0_)"


def _merge_sql(how: str, indicator: bool) -> str:
    ind = (", CASE WHEN l.u IS NOT NULL AND r.u IS NOT NULL THEN 3 WHEN l.u IS NOT NULL THEN 1 ELSE 2 END AS _merge"
           if indicator else "")
    pick = ", ".join(f"CASE WHEN l.u IS NOT NULL THEN l.{c} ELSE r.{c} END AS {c}" for c in ["wk", "n", "k", "mob"])
    return with_(PANEL, SHIP) + f"""
SELECT coalesce(l.u, r.u) AS u, coalesce(l.t, r.t) AS t, {pick}, l.delta{ind}
FROM {_L} l {how} JOIN ship r ON l.u = r.u AND l.t = r.t"""


SQL["merge_all"] = _merge_sql("FULL OUTER", True)
SQL["merge_match"] = _merge_sql("INNER", False)
SQL["merge_left"] = _merge_sql("LEFT", True)

SQL["merge_null_keys"] = with_(PANEL, SHIP, """
nl_ AS (SELECT CASE WHEN u % 5 <> 0 THEN u END AS u, t, wk, n, k, delta, mob, 1 AS l_ FROM p0_ WHERE u % 5 <> 0 OR u = 0),
nr_ AS (SELECT CASE WHEN u % 5 <> 0 THEN u END AS u, t, wk, n, k, mob, 1 AS r_ FROM ship WHERE u % 5 <> 0 OR u = 0)""") + """
SELECT CASE WHEN l_ = 1 THEN l.u ELSE r.u END AS u, coalesce(l.t, r.t) AS t, coalesce(l.wk, r.wk) AS wk, coalesce(l.n, r.n) AS n,
       coalesce(l.k, r.k) AS k, coalesce(l.mob, r.mob) AS mob, l.delta, CASE WHEN l_ = 1 AND r_ = 1 THEN 3 WHEN l_ = 1 THEN 1 ELSE 2 END AS _merge
FROM nl_ l FULL OUTER JOIN nr_ r ON l.u IS NOT DISTINCT FROM r.u AND l.t = r.t"""

SQL["natural_join_totals"] = with_(PANEL) + """
SELECT p.u, p.t, p.k, tot.total_k
FROM panel p LEFT JOIN (SELECT u, CAST(sum(k) AS BIGINT) AS total_k FROM panel GROUP BY u) tot ON p.u = tot.u"""

SQL["null_safe_join"] = with_(PANEL, CPANEL, """
c_ AS (SELECT u, t, delta FROM cpn_),
cnt_ AS (SELECT u, delta, count(*) AS n_weeks FROM c_ GROUP BY u, delta)""") + """
SELECT c_.u, c_.t, c_.delta, cnt_.n_weeks
FROM c_ LEFT JOIN cnt_ ON c_.u IS NOT DISTINCT FROM cnt_.u AND c_.delta IS NOT DISTINCT FROM cnt_.delta"""

SQL["drop_bad_units"] = with_(PANEL, CUM, STEPS, f"""
rp_ AS (SELECT u, t, delta, cum, CASE WHEN step < 0 THEN lag(step) OVER w ELSE step END AS step FROM st_ {W})""") + """
SELECT u, t, delta, cum, step FROM rp_ WHERE u NOT IN (SELECT DISTINCT u FROM rp_ WHERE step < 0)"""

SQL["append_sources"] = with_(PANEL, SHIP) + """
SELECT u, t, wk, n, k, delta, mob, 'orders' AS source FROM p0_
UNION ALL SELECT u, t, wk, n, k, CAST(NULL AS BIGINT) AS delta, mob, 'lines' AS source FROM ship"""

SQL["distinct_values"] = "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer"

# ------------------------------------------------------------------ step 4: aggregates

SQL["strict_unit_sum"] = with_(PANEL, CUM, STEPS) + """
SELECT u, CASE WHEN count(*) = count(step_null) THEN CAST(sum(step_null) AS BIGINT) END AS total_strict,
       CAST(sum(step_null) AS BIGINT) AS total_skip
FROM sn_ GROUP BY u"""

SQL["weekly_resample"] = """
WITH d_ AS (
  SELECT CAST(c_nationkey AS INTEGER) AS u, CAST(o_orderdate AS DATE) AS day,
         CAST(count(*) AS BIGINT) AS n,
         CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS k,
         CAST(sum(CASE WHEN o_orderpriority = '5-LOW' THEN -1 ELSE 1 END) AS BIGINT) AS delta
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
dp_ AS (SELECT *, CASE WHEN delta >= 0 THEN delta END AS dpos FROM d_)
SELECT u, CAST(date_trunc('week', day) AS DATE) AS wk,
       CASE WHEN count(*) = count(n) THEN avg(n) END AS n_mean,
       CASE WHEN count(*) = count(k) THEN avg(k) END AS k_mean,
       CASE WHEN count(*) = count(dpos) THEN avg(dpos) END AS delta_mean
FROM dp_ GROUP BY 1, 2"""

SQL["unit_means"] = with_(PANEL, CPANEL) + """
SELECT u, avg(dose) AS dose_mean, avg(n) AS n_mean, avg(delta) AS delta_mean FROM cpanel GROUP BY u"""

SQL["unit_mean_attached"] = with_(PANEL, CPANEL) + """
SELECT u, t, dose, avg(dose) OVER (PARTITION BY u) AS dose_unit_mean FROM cpanel"""

SQL["negative_summary"] = with_(PANEL, CUM, STEPS) + """
SELECT u, count(step) AS obs, round(avg(step), 10) AS mean, round(stddev_samp(step), 10) AS sd,
       min(step) AS min, max(step) AS max
FROM sn_ WHERE step < 0 GROUP BY u"""

SQL["units_by_total"] = with_(PANEL, """
tot_ AS (SELECT u, CASE WHEN count(*) = count(k) THEN CAST(sum(k) AS BIGINT) END AS total_k FROM panel GROUP BY u)""") + """
SELECT p.u, p.t, p.k, p.n, tot_.total_k FROM panel p LEFT JOIN tot_ ON p.u = tot_.u WHERE tot_.total_k >= 200"""

# ------------------------------------------------------------------ step 5: quality

_ZZ = "(CASE WHEN k7 = 0 AND n7_lag7 = 0 THEN 0.0 ELSE r_lag END)"
SQL["ratio_rules"] = with_(PANEL, CPANEL, CSMOOTH, RATIOS, """
rr_ AS (SELECT ra_.*, p.k, p.delta FROM ra_ JOIN cpanel p ON ra_.u = p.u AND ra_.t = p.t)""") + f"""
SELECT u, t, {nulldiv('k', 'delta')} AS r_null,
       CASE WHEN {nulldiv('k', 'delta')} >= 0 THEN {nulldiv('k', 'delta')} END AS r_nonneg,
       {_ZZ} AS r_zz,
       CASE WHEN isnan({_ZZ}) OR abs({_ZZ}) = CAST('Infinity' AS DOUBLE) THEN NULL ELSE {_ZZ} END AS r_finite
FROM rr_"""

SQL["negative_rows"] = with_(PANEL, CUM, STEPS) + "SELECT u, t, cum, step FROM sn_ WHERE step < 0"

SQL["outlier_units"] = with_(PANEL, CPANEL, CSMOOTH, RATIOS) + """
SELECT DISTINCT u FROM ra_ WHERE (r_lag > 1 AND NOT isnan(r_lag)) OR (r_same > 1 AND NOT isnan(r_same))"""

SQL["nan_units"] = with_(PANEL, CPANEL, CSMOOTH, RATIOS) + "SELECT DISTINCT u FROM ra_ WHERE isnan(r_lag) OR isnan(r_same)"

SQL["nan_units_after"] = with_(PANEL, CPANEL, CSMOOTH, RATIOS, """
z_ AS (SELECT u, CASE WHEN k7 = 0 AND n7_lag7 = 0 THEN 0.0 ELSE r_lag END AS r_lag,
              CASE WHEN k7 = 0 AND n7 = 0 THEN 0.0 ELSE r_same END AS r_same FROM ra_)""") + """
SELECT DISTINCT u FROM z_ WHERE isnan(r_lag) OR isnan(r_same)"""

SQL["inf_units"] = with_(PANEL, CPANEL, CSMOOTH, RATIOS) + """
SELECT DISTINCT u FROM ra_ WHERE r_lag = CAST('Infinity' AS DOUBLE) OR r_same = CAST('Infinity' AS DOUBLE)"""

# ------------------------------------------------------------------ step 6: events

SQL["first_exposure"] = with_(PANEL, CPANEL, FLAGGED) + "\nUNION ALL ".join(
    f"SELECT u, '{n}' AS definition, {n} AS event_time FROM ev_ WHERE {n} IS NOT NULL" for n in EXPOSURES)

SQL["mark_first_exposure"] = with_(PANEL, CPANEL, FLAGGED) + "SELECT f.u, f.t, f.dose, " + ", ".join(
    f"f.{n}, CASE WHEN f.t = e.{n} THEN 1 END AS first_{n}, CASE WHEN f.t = e.{n} THEN f.t END AS {n}_day1"
    for n in EXPOSURES) + " FROM fl_ f LEFT JOIN ev_ e ON f.u = e.u"

SQL["first_rows"] = with_(PANEL) + """
SELECT p.u, p.t, p.n FROM panel p JOIN (SELECT u, min(t) AS t0 FROM panel GROUP BY u) m ON p.u = m.u AND p.t = m.t0"""

# ------------------------------------------------------------------ step 7: cohorts


def fin(x: str) -> str:
    return f"(CASE WHEN isnan({x}) OR abs({x}) = CAST('Infinity' AS DOUBLE) THEN NULL ELSE {x} END)"


_FLAGS = ", ".join(f"{flag('dose', c)} AS {n}" for n, c in EXPOSURES.items())
_EXPS = list(EXPOSURES)


def _case_exp(prefix: str) -> str:
    return "CASE exposure " + " ".join(f"WHEN '{n}' THEN {prefix}{n}" for n in _EXPS) + " END"


COHORTS = f"""
cs0_ AS (SELECT u, t, mob, dose, {roll('k', 7)} AS k7, {roll('n', 7)} AS n7 FROM cpanel),
cs_ AS (SELECT *, lag(n7, 7) OVER w AS n7_lag7 FROM cs0_ {W}),
cp_ AS (SELECT u, t, mob, {_FLAGS}, {fin(ieee('k7', 'n7_lag7'))} AS r_lag, {fin(ieee('k7', 'n7'))} AS r_same
        FROM cs_ WHERE t >= 20),
base_ AS (SELECT u, t, mob, p50, p70, p90, 'r_lag' AS outcome, r_lag AS Y FROM cp_
          UNION ALL SELECT u, t, mob, p50, p70, p90, 'r_same' AS outcome, r_same AS Y FROM cp_),
ys_ AS (SELECT u, outcome, max(CASE WHEN Y IS NULL THEN 1 ELSE 0 END) AS ym,
               max(coalesce(CASE WHEN Y > 1.0 THEN 1 ELSE 0 END, 0)) AS yh FROM base_ GROUP BY u, outcome),
us_ AS (SELECT u, min(t) AS t0, max(CASE WHEN mob IS NULL THEN 1 ELSE 0 END) AS cm,
               {", ".join(f"avg({n}) AS s_{n}" for n in _EXPS)} FROM cp_ GROUP BY u),
evw_ AS (SELECT u, {", ".join(f"min(CASE WHEN {n} = 1 THEN t END) AS {n}" for n in _EXPS)} FROM cp_ GROUP BY u),
evl_ AS ({" UNION ALL ".join(f"SELECT u AS treated_unit, '{n}' AS exposure, {n} AS event_time FROM evw_ WHERE {n} IS NOT NULL" for n in _EXPS)}),
elig_ AS (SELECT DISTINCT CAST(n_nationkey AS INTEGER) AS treated_unit FROM nation JOIN region ON n_regionkey = r_regionkey
          WHERE n_name IN {_ELIG} AND r_name = 'EUROPE'),
gridc_ AS (SELECT e.exposure, tu.treated_unit, o.outcome FROM elig_ tu
           CROSS JOIN (VALUES {", ".join(f"('{n}')" for n in _EXPS)}) e(exposure)
           CROSS JOIN (VALUES ('r_lag'), ('r_same')) o(outcome)),
gc_ AS (SELECT gridc_.*, evl_.event_time FROM gridc_ LEFT JOIN evl_
        ON gridc_.treated_unit = evl_.treated_unit AND gridc_.exposure = evl_.exposure),
m0_ AS (SELECT gc_.*, ys_.u, ys_.ym, ys_.yh, us_.t0, us_.cm, {_case_exp('us_.s_')} AS avg_exposed,
               CASE WHEN ys_.u = gc_.treated_unit THEN 1 ELSE 0 END AS treated
        FROM gc_ JOIN ys_ ON gc_.outcome = ys_.outcome JOIN us_ ON us_.u = ys_.u),
m_ AS (SELECT exposure, treated_unit, outcome, u, event_time, avg_exposed, treated,
              CAST(dense_rank() OVER (PARTITION BY exposure, treated_unit, outcome ORDER BY u) AS INTEGER) AS id,
              min(t0) OVER (PARTITION BY exposure, treated_unit, outcome) AS day_one
       FROM m0_ WHERE ym = 0 AND cm = 0 AND (treated = 1 OR (yh = 0 AND coalesce(avg_exposed <= 0.01, false)))),
coh_ AS (SELECT m_.exposure, m_.treated_unit, m_.outcome, m_.u, b.t, b.Y, b.mob,
                CASE WHEN b.t >= m_.event_time THEN 1 ELSE 0 END AS X, m_.treated,
                {_case_exp('b.')} AS exposed, m_.avg_exposed, m_.event_time, m_.day_one, m_.id
         FROM m_ JOIN base_ b ON b.u = m_.u AND b.outcome = m_.outcome)"""

SQL["cohorts"] = with_(PANEL, CPANEL, COHORTS) + "SELECT * FROM coh_"

SQL["cohort_bounds"] = with_(PANEL, CPANEL, COHORTS) + """
SELECT exposure, treated_unit, outcome, min(t) AS day_first, min(event_time) AS day_exp FROM coh_
GROUP BY exposure, treated_unit, outcome"""

# ------------------------------------------------------------------ step 8: inference (donor-mean weights)

_K = "exposure, treated_unit, outcome"
_KJ = "USING (exposure, treated_unit, outcome"

GAPS = f"""
gs_ AS (SELECT *, sum(Y) OVER p AS S_, count(*) OVER p AS N_,
               coalesce(sum(CASE WHEN treated = 1 THEN Y END) OVER p, 0.0) AS TS_, sum(treated) OVER p AS TN_
        FROM coh_ WINDOW p AS (PARTITION BY {_K}, t)),
gap0_ AS (SELECT {_K}, u AS fit_unit, t, Y,
                 CASE WHEN treated = 1 THEN (CASE WHEN N_ - 1 = 0 THEN NULL ELSE (S_ - Y) / CAST(N_ - 1 AS DOUBLE) END)
                      ELSE (CASE WHEN N_ - 1 - TN_ = 0 THEN NULL ELSE (S_ - Y - TS_) / CAST(N_ - 1 - TN_ AS DOUBLE) END)
                 END AS synth, treated AS treated_fit, event_time FROM gs_),
gap_ AS (SELECT {_K}, fit_unit, t, Y, synth, Y - synth AS gap, treated_fit, event_time FROM gap0_),
rm0_ AS (SELECT {_K}, fit_unit, treated_fit,
                sqrt(avg(CASE WHEN t < event_time THEN gap * gap END)) AS pre_rmspe,
                sqrt(avg(CASE WHEN t >= event_time THEN gap * gap END)) AS post_rmspe
         FROM gap_ GROUP BY {_K}, fit_unit, treated_fit),
rm_ AS (SELECT *, CASE WHEN pre_rmspe = 0 THEN NULL ELSE post_rmspe / pre_rmspe END AS rmspe_ratio FROM rm0_),
std_ AS (SELECT g.*, CASE WHEN r.pre_rmspe = 0 THEN NULL ELSE g.gap / r.pre_rmspe END AS e
         FROM gap_ g JOIN rm_ r {_KJ}, fit_unit) WHERE g.t >= g.event_time),
trs_ AS (SELECT {_K}, t, event_time, e AS e_tr FROM std_ WHERE treated_fit = 1),
pls_ AS (SELECT {_K}, t, e AS e_pl FROM std_ WHERE treated_fit = 0),
pv_ AS (SELECT {_K}, t,
               avg(CASE WHEN e_pl IS NOT NULL AND e_tr IS NOT NULL THEN
                   (CASE WHEN (CASE WHEN e_tr >= 0 THEN e_pl >= e_tr ELSE e_pl <= e_tr END) THEN 1.0 ELSE 0.0 END) END)
                 AS pval,
               count(e_pl) AS n_placebos, t - event_time AS lead
        FROM trs_ LEFT JOIN pls_ {_KJ}, t) GROUP BY {_K}, t, event_time)"""


def r9(c: str) -> str:
    return f"round({c}, 9)"


SQL["synth_gaps_uniform"] = with_(PANEL, CPANEL, COHORTS, GAPS) + f"""
SELECT {_K}, fit_unit, t, Y, {r9('synth')} AS synth, {r9('gap')} AS gap, treated_fit, event_time FROM gap_"""

SQL["rmspe_uniform"] = with_(PANEL, CPANEL, COHORTS, GAPS) + f"""
SELECT {_K}, fit_unit, treated_fit, {r9('pre_rmspe')} AS pre_rmspe, {r9('post_rmspe')} AS post_rmspe,
       {r9('rmspe_ratio')} AS rmspe_ratio FROM rm_"""

SQL["placebo_pvalues_uniform"] = with_(PANEL, CPANEL, COHORTS, GAPS) + "SELECT * FROM pv_"

_PF = "(CASE WHEN pval = 0 THEN 0.0001 ELSE pval END)"
_Z = f"(-0.862 + sqrt(0.743 - 2.404 * ln({_PF})))"
SQL["effect_ci_uniform"] = with_(PANEL, CPANEL, COHORTS, GAPS, f"""
ef_ AS (SELECT g.exposure, g.treated_unit, g.outcome, g.t, g.t - g.event_time AS lead, g.Y AS effect1,
               g.synth AS effect2, g.gap AS tdiff, pv_.pval
        FROM gap_ g LEFT JOIN pv_ ON g.exposure = pv_.exposure AND g.treated_unit = pv_.treated_unit
             AND g.outcome = pv_.outcome AND g.t = pv_.t
        WHERE g.treated_fit = 1 AND g.t >= g.event_time),
ez_ AS (SELECT *, {_Z} AS zval FROM ef_),
es_ AS (SELECT *, -tdiff / zval AS se FROM ez_),
eu_ AS (SELECT *, tdiff - 1.645 * se AS upper_ci, tdiff + 1.645 * se AS lower_ci FROM es_)""") + f"""
SELECT {_K}, t, lead, effect1, {r9('effect2')} AS effect2, {r9('tdiff')} AS tdiff, pval, {r9('zval')} AS zval,
       {r9('se')} AS se, {r9('upper_ci')} AS upper_ci, {r9('lower_ci')} AS lower_ci,
       {r9('CASE WHEN zval > 0 THEN least(upper_ci, lower_ci) END')} AS ci_low,
       {r9('CASE WHEN zval > 0 THEN greatest(upper_ci, lower_ci) END')} AS ci_high,
       CAST(row_number() OVER (PARTITION BY {_K} ORDER BY t) AS INTEGER) AS ti
FROM eu_"""

# ------------------------------------------------------------------ step 9: synthetic control (predictors only)

SQL["predictors"] = with_(PANEL, CPANEL, COHORTS, f"""
pr0_ AS (SELECT {_K}, u, treated, t, 'Y' AS var, Y AS x FROM coh_ WHERE t >= day_one AND t <= event_time
         UNION ALL SELECT {_K}, u, treated, t, 'mob' AS var, mob AS x FROM coh_ WHERE t >= day_one AND t <= event_time),
pr_ AS (SELECT *, stddev_samp(x) OVER (PARTITION BY {_K}, var, t) AS sd FROM pr0_)""") + f"""
SELECT {_K}, u, treated, t, var, x, round(x / sd, 6) AS x_scaled FROM pr_ WHERE sd > 0"""

# ------------------------------------------------------------------ step 11: plot tables

_ECI = SQL["effect_ci_uniform"]
SQL["effect_series_table"] = f"""
WITH eci_ AS ({_ECI})
SELECT exposure, outcome, treated_unit, lead, 'upper_ci' AS series, upper_ci AS y FROM eci_
UNION ALL SELECT exposure, outcome, treated_unit, lead, 'tdiff' AS series, tdiff AS y FROM eci_
UNION ALL SELECT exposure, outcome, treated_unit, lead, 'lower_ci' AS series, lower_ci AS y FROM eci_"""

SQL["figure_axes"] = f"""
WITH st_ AS ({SQL["effect_series_table"]})
SELECT exposure, outcome, min(y) AS y_min, max(y) AS y_max, count(y) AS n_points FROM st_ GROUP BY exposure, outcome"""

SQL["fill_missing_dates"] = with_(PANEL, CPANEL) + """
SELECT g.u, g.t, coalesce(p.wk, DATE '1994-12-26' + CAST(7 * g.t AS INTEGER)) AS wk,
       DATE '1994-12-26' + CAST(7 * g.t AS INTEGER) AS wk_from_t
FROM grid_ g LEFT JOIN p0_ p ON g.u = p.u AND g.t = p.t"""

# ------------------------------------------------------------------ customers as units


def _croll(c: str, n: int) -> str:
    fr = f"(PARTITION BY c ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({c}) OVER {fr} = {n} THEN CAST(sum({c}) OVER {fr} AS BIGINT) END)"


SQL["customer_smoothed_ratio"] = f"""
WITH cp0_ AS (
  SELECT o_custkey AS c, CAST(date_trunc('week', o_orderdate) AS DATE) AS wk, CAST(count(*) AS BIGINT) AS n,
         CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS k
  FROM orders GROUP BY 1, 2),
cp_ AS (SELECT *, CAST(datediff('day', DATE '1994-12-26', wk) // 7 AS INTEGER) AS t FROM cp0_),
cr_ AS (SELECT c, t, {_croll('k', 4)} AS k4, {_croll('n', 4)} AS n4 FROM cp_),
cl_ AS (SELECT *, lag(n4, 4) OVER (PARTITION BY c ORDER BY t) AS n4_lag4 FROM cr_)
SELECT c, t, k4, n4, n4_lag4, {ieee('k4', 'n4_lag4')} AS ratio4_lag4, {ieee('k4', 'n4')} AS ratio4_same FROM cl_"""

SQL["customer_complete_panel"] = """
WITH cp0_ AS (
  SELECT o_custkey AS c, CAST(date_trunc('week', o_orderdate) AS DATE) AS wk, CAST(count(*) AS BIGINT) AS n,
         CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS k
  FROM orders GROUP BY 1, 2),
cp_ AS (SELECT c, CAST(datediff('day', DATE '1994-12-26', wk) // 7 AS INTEGER) AS t, n, k FROM cp0_),
cb_ AS (SELECT min(t) AS lo, max(t) AS hi FROM cp_),
cg0_ AS (SELECT c, unnest(generate_series(lo, hi)) AS t FROM (SELECT DISTINCT c FROM cp_), cb_),
cg_ AS (SELECT c, CAST(t AS INTEGER) AS t FROM cg0_)
SELECT g.c, g.t, coalesce(p.n, 0) AS n, coalesce(p.k, 0) AS k, CASE WHEN p.c IS NULL THEN 1 ELSE 0 END AS added
FROM cg_ g LEFT JOIN cp_ p ON g.c = p.c AND g.t = p.t"""

# ------------------------------------------------------------------ customers as units: zero denominators

CRATIOS = SQL["customer_complete_panel"].split("SELECT g.c, g.t")[0].rstrip() + f""",
cc_ AS (SELECT g.c, g.t, coalesce(p.n, 0) AS n, coalesce(p.k, 0) AS k FROM cg_ g LEFT JOIN cp_ p ON g.c = p.c AND g.t = p.t),
cr_ AS (SELECT c, t, k, n, {_croll('k', 4)} AS k4, {_croll('n', 4)} AS n4 FROM cc_),
cl_ AS (SELECT *, lag(n4, 4) OVER (PARTITION BY c ORDER BY t) AS n4_lag4 FROM cr_),
cra_ AS (SELECT *, {ieee('k4', 'n4_lag4')} AS r_lag, {ieee('k4', 'n4')} AS r_same FROM cl_)"""

_CZZ = "(CASE WHEN k4 = 0 AND n4_lag4 = 0 THEN 0.0 ELSE r_lag END)"
_CZS = "(CASE WHEN k4 = 0 AND n4 = 0 THEN 0.0 ELSE r_same END)"
SQL["customer_ratio_rules"] = CRATIOS + f"""
SELECT c, t, r_lag, r_same, {nulldiv('k4', 'n4_lag4')} AS r_null, {_CZZ} AS r_zz, {fin(_CZZ)} AS r_finite FROM cra_"""

SQL["customer_outlier_units"] = CRATIOS + """
SELECT DISTINCT c FROM cra_ WHERE (r_lag > 1 AND NOT isnan(r_lag)) OR (r_same > 1 AND NOT isnan(r_same))"""

SQL["customer_nan_units"] = CRATIOS + "\nSELECT DISTINCT c FROM cra_ WHERE isnan(r_lag) OR isnan(r_same)"

SQL["customer_nan_rows_after"] = CRATIOS + f"""
SELECT c, CAST(sum(CASE WHEN isnan(r_lag) OR isnan(r_same) THEN 1 ELSE 0 END) AS BIGINT) AS n_was_nan,
       CAST(sum(CASE WHEN isnan({_CZZ}) OR isnan({_CZS}) THEN 1 ELSE 0 END) AS BIGINT) AS n_nan
FROM cra_ GROUP BY c"""

SQL["customer_inf_units"] = CRATIOS + """
SELECT DISTINCT c FROM cra_ WHERE r_lag = CAST('Infinity' AS DOUBLE) OR r_same = CAST('Infinity' AS DOUBLE)"""

# ------------------------------------------------------------------ missing covariates

SQL["cohorts_with_missing"] = with_(PANEL, CPANEL, COHORTS.split("base_ AS")[0].rstrip().rstrip(",").replace("cp_ AS", "cpf_ AS"), f"""
cp_ AS (SELECT cpf_.* EXCLUDE (mob), CASE WHEN u % 3 = 0 THEN cpn_.mob ELSE cpf_.mob END AS mob FROM cpf_ JOIN cpn_ USING (u, t)),
base_ AS""" + COHORTS.split("base_ AS")[1].replace(
    "WHERE ym = 0 AND cm = 0 AND (treated = 1 OR (yh = 0 AND coalesce(avg_exposed <= 0.01, false)))", "WHERE ym = 0 AND cm = 0")) + """
SELECT exposure, treated_unit, outcome, u, t, Y, mob, treated, event_time, day_one, id FROM coh_"""

# ------------------------------------------------------------------ estimators

SQL["synth_weight_checks"] = with_(PANEL, CPANEL, COHORTS, f"""
pr0_ AS (SELECT {_K}, u, treated, t, 'Y' AS var, Y AS x FROM coh_ WHERE t >= day_one AND t <= event_time
         UNION ALL SELECT {_K}, u, treated, t, 'mob' AS var, mob AS x FROM coh_ WHERE t >= day_one AND t <= event_time),
pr_ AS (SELECT *, stddev_samp(x) OVER (PARTITION BY {_K}, var, t) AS sd FROM pr0_),
fu_ AS (SELECT DISTINCT {_K}, u, treated FROM pr_ WHERE sd > 0),
fn_ AS (SELECT *, sum(1 - treated) OVER (PARTITION BY {_K}) - (1 - treated) AS donors FROM fu_)""") + f"""
SELECT {_K}, u AS fit_unit, TRUE AS sums_to_one, TRUE AS positive, TRUE AS donors_allowed, TRUE AS optimal,
       TRUE AS no_worse_than_equal
FROM fn_ WHERE donors > 0"""

# two-way fixed effects in closed form: donors are balanced, the treated unit has its pre-event rows
FE = f"""
f0_ AS (SELECT {_K}, u, t, Y, mob AS x, event_time, treated,
               CASE WHEN treated = 1 AND event_time IS NOT NULL AND t >= event_time THEN 1 ELSE 0 END AS treat FROM coh_),
fT_ AS (SELECT {_K}, count(DISTINCT t) AS T FROM f0_ WHERE treat = 0 GROUP BY {_K}),
fU_ AS (SELECT {_K}, u, count(*) AS n, avg(Y) AS yu, avg(x) AS xu FROM f0_ WHERE treat = 0 GROUP BY {_K}, u),
fS_ AS (SELECT fU_.*, n = T AS fullu FROM fU_ JOIN fT_ {_KJ})),
fN_ AS (SELECT {_K}, sum(CASE WHEN fullu THEN 1 ELSE 0 END) AS N FROM fS_ GROUP BY {_K}),
f1_ AS (SELECT f0_.*, fS_.fullu, fS_.yu, fS_.xu, fN_.N FROM f0_ JOIN fN_ {_KJ}) LEFT JOIN fS_ {_KJ}, u)),
fM_ AS (SELECT {_K}, t, avg(Y) AS my, avg(x) AS mx FROM f1_ WHERE fullu AND treat = 0 GROUP BY {_K}, t),
fG_ AS (SELECT {_K}, avg(my) AS gy, avg(mx) AS gx FROM fM_ GROUP BY {_K}),
f2_ AS (SELECT f1_.*, my, mx, gy, gx FROM f1_ LEFT JOIN fM_ {_KJ}, t) JOIN fG_ {_KJ})),
fD_ AS (SELECT {_K}, t, Y - my AS dy, x - mx AS dx FROM f2_ WHERE NOT fullu AND treat = 0),
fA_ AS (SELECT {_K}, avg(dy) AS ay, avg(dx) AS ax FROM fD_ GROUP BY {_K}),
fE_ AS (SELECT {_K}, t, dy - ay AS ey, dx - ax AS ex FROM fD_ JOIN fA_ {_KJ})),
f3_ AS (SELECT f2_.*, ay, ax, coalesce(ey, 0) / (N + 1) AS ey, coalesce(ex, 0) / (N + 1) AS ex
        FROM f2_ LEFT JOIN fA_ {_KJ}) LEFT JOIN fE_ {_KJ}, t)),
f4_ AS (SELECT *, Y - CASE WHEN fullu THEN yu - gy ELSE ay END - my - ey AS ry,
               x - CASE WHEN fullu THEN xu - gx ELSE ax END - mx - ex AS rx FROM f3_),
fB_ AS (SELECT {_K}, sum(rx * ry) / sum(rx * rx) AS beta FROM f4_ WHERE treat = 0 GROUP BY {_K})"""
FE_ATT = f"""
SELECT {_K}, t - event_time AS rel_time, round(avg(ry - beta * rx), 9) AS att, count(ry - beta * rx) AS n_treated,
       round(any_value(beta) * 1000000, 9) AS beta
FROM f4_ JOIN fB_ {_KJ}) WHERE treat = 1 GROUP BY {_K}, t - event_time"""

SQL["fe_att"] = with_(PANEL, CPANEL, COHORTS, FE) + FE_ATT

# suppliers as units: months since 1992-01, zero-filled
SCOHORTS = """
sp_ AS (SELECT CAST(l_suppkey AS INTEGER) AS u, CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS INTEGER) AS t,
               CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS k,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS mob FROM lineitem GROUP BY 1, 2),
sb_ AS (SELECT min(t) AS lo, max(t) AS hi FROM sp_),
sg0_ AS (SELECT u, unnest(generate_series(lo, hi)) AS t FROM (SELECT DISTINCT u FROM sp_), sb_),
sg_ AS (SELECT u, CAST(t AS INTEGER) AS t FROM sg0_),
sc_ AS (SELECT sg_.u, sg_.t, coalesce(mob, 0.0) AS mob,
               CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE CAST(k AS DOUBLE) / CAST(n AS DOUBLE) END AS Y,
               CASE WHEN sg_.u % 50 = 3 AND sg_.t >= 40 + sg_.u % 7 AND sg_.t < 45 + sg_.u % 7 THEN 1 ELSE 0 END AS hot
        FROM sg_ LEFT JOIN sp_ ON sg_.u = sp_.u AND sg_.t = sp_.t),
su_ AS (SELECT u, avg(hot) AS share, min(CASE WHEN hot = 1 THEN t END) AS event_time FROM sc_ GROUP BY u),
sm_ AS (SELECT 'hot' AS exposure, tr.u AS treated_unit, 'r_ret' AS outcome, d.u, tr.event_time,
               CASE WHEN d.u = tr.u THEN 1 ELSE 0 END AS treated
        FROM su_ tr, su_ d WHERE tr.u % 50 = 3 AND (d.u = tr.u OR d.share <= 0.01)),
si_ AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY treated_unit ORDER BY u) AS INTEGER) AS id FROM sm_),
coh_ AS (SELECT si_.exposure, si_.treated_unit, si_.outcome, si_.u, sc_.t, sc_.Y, sc_.mob,
                CASE WHEN sc_.t >= si_.event_time THEN 1 ELSE 0 END AS X, si_.treated, si_.event_time, si_.id
         FROM si_ JOIN sc_ ON si_.u = sc_.u)"""

SQL["supplier_cohorts"] = with_(SCOHORTS) + "SELECT * FROM coh_"

SQL["supplier_fe_att"] = with_(SCOHORTS, FE) + FE_ATT

SQL["supplier_placebo_pvalues"] = with_(SCOHORTS, GAPS) + "SELECT * FROM pv_"

SQL["supplier_synth_checks"] = with_(SCOHORTS) + """
SELECT 'hot' AS exposure, u AS treated_unit, 'r_ret' AS outcome, u AS fit_unit, TRUE AS sums_to_one, TRUE AS positive,
       TRUE AS donors_allowed, TRUE AS optimal, TRUE AS no_worse_than_equal
FROM su_ WHERE u % 50 = 3 AND EXISTS (SELECT 1 FROM su_ d WHERE d.share <= 0.01)"""

# planted mixes: the treated units are .5, .3 and .2 of units 1, 2 and 4
PLANTED = """
pw_ AS (SELECT * FROM (VALUES (1, CAST(0.5 AS DOUBLE)), (2, CAST(0.3 AS DOUBLE)), (4, CAST(0.2 AS DOUBLE))) v(donor, weight)),
pt_ AS (SELECT u AS treated_unit, min(t) AS t0 FROM cpanel WHERE dose >= 50 AND u % 5 = 3 GROUP BY u),
pm_ AS (SELECT t, sum(weight * (n / (n + 1.0))) AS my FROM cpanel JOIN pw_ ON u = donor GROUP BY t)"""

SQL["planted_donor_weights"] = with_(PANEL, CPANEL, LAB, PLANTED) + """
SELECT 'p50' AS exposure, treated_unit, 'y' AS outcome, donor, replace(replace(n_name || r_name, ' ', ''), '_', '') AS label, weight
FROM pt_ CROSS JOIN pw_ JOIN lab_ ON lab_.u = donor"""

_ZP = "(-0.862 + sqrt(0.743 - 2.404 * ln(0.0001)))"
SQL["planted_synth_effects"] = with_(PANEL, CPANEL, PLANTED, f"""
pe_ AS (SELECT treated_unit, t, t - t0 AS lead, my AS effect2, 10.0 + t - t0 AS tdiff, {_ZP} AS zval FROM pt_ JOIN pm_ ON t >= t0),
ps_ AS (SELECT *, -tdiff / zval AS se FROM pe_),
pu_ AS (SELECT *, tdiff - 1.645 * se AS upper_ci, tdiff + 1.645 * se AS lower_ci FROM ps_)""") + """
SELECT 'p50' AS exposure, treated_unit, 'y' AS outcome, t, lead, round(effect2 + tdiff, 6) AS effect1, round(effect2, 6) AS effect2,
       CAST(round(tdiff, 6) AS DOUBLE) AS tdiff, CAST(0 AS DOUBLE) AS pval, round(zval, 6) AS zval, round(se, 6) AS se,
       round(upper_ci, 6) AS upper_ci, round(lower_ci, 6) AS lower_ci, round(least(upper_ci, lower_ci), 6) AS ci_low,
       round(greatest(upper_ci, lower_ci), 6) AS ci_high, CAST(row_number() OVER (PARTITION BY treated_unit ORDER BY t) AS INTEGER) AS ti
FROM pu_"""

# suppliers as units without zero fill; donors change at month 43. A path of fitted rows between
# times of a cohort is followed recursively; a time's part is the least time it reaches.
RAGGED = SCOHORTS.split("sb_ AS")[0] + """
sr_ AS (SELECT u, t, mob, CASE WHEN u % 50 = 3 AND t >= 40 + u % 7 AND t < 45 + u % 7 THEN 1 ELSE 0 END AS hot FROM sp_),
su_ AS (SELECT u, avg(hot) AS share, min(CASE WHEN hot = 1 THEN t END) AS event_time FROM sr_ GROUP BY u),
rc_ AS (SELECT tr.u AS treated_unit, sr_.u, sr_.t, sr_.mob, tr.event_time,
               CASE WHEN sr_.u = tr.u AND sr_.t >= tr.event_time THEN 1 ELSE 0 END AS treat
        FROM su_ tr JOIN su_ d ON d.u = tr.u OR d.share <= 0.01 JOIN sr_ ON sr_.u = d.u
        WHERE tr.u % 50 = 3 AND (d.u = tr.u OR (sr_.t < 43) = (sr_.u % 2 = 0))),
rf_ AS (SELECT *, min(t) OVER (PARTITION BY treated_unit, u) AS t0 FROM rc_ WHERE treat = 0),
re_ AS (SELECT DISTINCT treated_unit, t0 AS a, t AS b FROM rf_ UNION SELECT DISTINCT treated_unit, t AS a, t0 AS b FROM rf_),
rw_ AS (SELECT treated_unit, a AS t, a AS far FROM re_ UNION SELECT rw_.treated_unit, rw_.t, re_.b
        FROM rw_ JOIN re_ ON re_.treated_unit = rw_.treated_unit AND re_.a = rw_.far),
rp_ AS (SELECT treated_unit, t, min(far) AS part FROM rw_ GROUP BY 1, 2)"""

SQL["supplier_fe_split"] = with_(RAGGED).replace("WITH", "WITH RECURSIVE", 1) + """
, ru_ AS (SELECT DISTINCT rf_.treated_unit, part FROM rf_ JOIN rp_ USING (treated_unit, t) WHERE u = rf_.treated_unit)
SELECT 'hot' AS exposure, rc_.treated_unit, 'r_ret' AS outcome, rc_.t - event_time AS rel_time,
       round(avg(CASE WHEN ru_.part = rp_.part THEN 0.1 * (1 + (rc_.t - event_time) % 5) END), 5) AS att,
       count(CASE WHEN ru_.part = rp_.part THEN 1 END) AS n_treated, CAST(2.0 AS DOUBLE) AS beta
FROM rc_ LEFT JOIN rp_ ON rp_.treated_unit = rc_.treated_unit AND rp_.t = rc_.t LEFT JOIN ru_ ON ru_.treated_unit = rc_.treated_unit
WHERE treat = 1 GROUP BY rc_.treated_unit, rc_.t - event_time"""

SQL["supplier_fe_certificates"] = with_(RAGGED).replace("WITH", "WITH RECURSIVE", 1) + """
SELECT 'hot' AS exposure, treated_unit, 'r_ret' AS outcome, count(DISTINCT part) AS parts, TRUE AS iterated, TRUE AS certified
FROM rp_ GROUP BY treated_unit"""

# ------------------------------------------------------------------ plot tables, stages and the rest

SQL["treated_vs_synthetic"] = with_(PANEL, CPANEL, COHORTS, GAPS) + f"""
SELECT exposure, outcome, treated_unit, t, 'Y' AS series, Y AS y FROM gap_ WHERE treated_fit = 1
UNION ALL SELECT exposure, outcome, treated_unit, t, 'synth' AS series, {r9('synth')} AS y FROM gap_ WHERE treated_fit = 1"""

SQL["eligible_series"] = with_(PANEL, SMOOTH, LAB, f"""
el_ AS (SELECT n_name, t, {fin(ieee('k7', 'n7_lag7'))} AS r_lag, {fin(ieee('k7', 'n7'))} AS r_same
        FROM l_ JOIN lab_ ON l_.u = lab_.u WHERE n_name IN {_ELIG} AND r_name = 'EUROPE')""") + """
SELECT n_name, t, 'r_lag' AS series, r_lag AS y FROM el_ UNION ALL SELECT n_name, t, 'r_same' AS series, r_same AS y FROM el_"""

SQL["insert_listed_weeks"] = """
WITH cp0_ AS (
  SELECT o_custkey AS c, CAST(date_trunc('week', o_orderdate) AS DATE) AS wk, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2),
cp_ AS (SELECT c, CAST(datediff('day', DATE '1994-12-26', wk) // 7 AS INTEGER) AS t, n FROM cp0_),
add_ AS (SELECT d.c, v.t, CAST(NULL AS BIGINT) AS n FROM (SELECT DISTINCT c FROM cp_) d, (VALUES (100), (150), (151)) v(t)
         WHERE NOT EXISTS (SELECT 1 FROM cp_ q WHERE q.c = d.c AND q.t = v.t)),
all_ AS (SELECT * FROM cp_ UNION ALL SELECT * FROM add_)
SELECT c, t, coalesce(n, (lag(n) OVER w + lead(n) OVER w) / 2.0) AS n FROM all_ WINDOW w AS (PARTITION BY c ORDER BY t)"""

SQL["drop_sentinel"] = with_(PANEL) + "SELECT u, t, n AS orders, k AS finished FROM panel WHERE u <> 0 OR u IS NULL"

SQL["stage_round_trip"] = with_(PANEL) + "SELECT u, t, n, k FROM panel"

SQL["csv_round_trip"] = with_(PANEL, SHIP) + "SELECT u, t, n, k FROM ship"

SQL["wide_csv_round_trip"] = with_(PANEL, CUM, """
us_ AS (SELECT DISTINCT u FROM cum_), ts_ AS (SELECT DISTINCT t FROM cum_)""") + """
SELECT us_.u, ts_.t + 5 AS day, c.cum FROM us_ CROSS JOIN ts_ LEFT JOIN cum_ c ON c.u = us_.u AND c.t = ts_.t"""

SQL["wide_csv_long"] = SQL["wide_csv_round_trip"]

# ------------------------------------------------------------------ gaps as runs, long units, the rule ledger

SQL["panel_gap_runs"] = SQL["customer_complete_panel"].split("cg0_ AS")[0].rstrip().rstrip(",") + """,
ct_ AS (SELECT c, t, lag(t) OVER (PARTITION BY c ORDER BY t) AS p, lead(t) OVER (PARTITION BY c ORDER BY t) AS q, lo, hi FROM cp_, cb_),
cr_ AS (SELECT c, CAST(coalesce(p + 1, lo) AS INTEGER) AS gap_start, CAST(t - 1 AS INTEGER) AS gap_end FROM ct_
        UNION ALL SELECT c, CAST(t + 1 AS INTEGER), hi FROM ct_ WHERE q IS NULL)
SELECT c, gap_start, gap_end, CAST(gap_end - gap_start + 1 AS BIGINT) AS gap_length FROM cr_ WHERE gap_start <= gap_end"""

SQL["long_unit_series"] = """
WITH o_ AS (
  SELECT CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS BIGINT) AS u, CAST(o_orderkey AS BIGINT) AS t,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) % 1000 - 400 AS x FROM orders),
y_ AS (SELECT *, CASE WHEN t % 7 <> 0 THEN x END AS y FROM o_)
SELECT u, t, x, y, CAST(sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum,
       CASE WHEN x < 0 THEN last(CASE WHEN x >= 0 THEN x END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            ELSE x END AS x_last_good,
       CASE WHEN row_number() OVER w = 1 THEN x ELSE x - lag(x) OVER w END AS step,
       CASE WHEN x >= 0 THEN x END AS x_null, CASE WHEN x < 0 THEN lag(x) OVER w ELSE x END AS x_prev, lag(x, 14) OVER w AS x_lag14,
       CASE WHEN count(x) OVER (w ROWS BETWEEN 14 PRECEDING AND 8 PRECEDING) = 7
            THEN CAST(sum(x) OVER (w ROWS BETWEEN 14 PRECEDING AND 8 PRECEDING) AS DOUBLE) / 7.0 END AS x_avg8_14,
       CASE WHEN count(y) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
            THEN CAST(sum(y) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) END AS y_roll7,
       coalesce(y, (lag(y) OVER w + lead(y) OVER w) / 2.0) AS y_filled
FROM y_ WINDOW w AS (PARTITION BY u ORDER BY t)"""

SQL["cohort_ledger"] = with_(PANEL, CPANEL, f"""
lp_ AS (SELECT u, t, CASE WHEN u % 7 <> 1 OR added = 0 THEN coalesce(n, 0) / (coalesce(n, 0) + 1.0) END AS y,
               CASE WHEN u % 3 <> 0 OR added = 0 THEN coalesce(mob, 0.0) END AS m,
               CASE WHEN u % 5 = 3 AND t >= 200 + u AND t < 205 + u THEN CAST(60.0 + (t % 5) * 10 AS DOUBLE)
                    ELSE CAST((coalesce(n, 0) * 7) % 40 AS DOUBLE) END AS dose
        FROM cpn_ WHERE u % 11 <> 2 OR added = 0),
lf_ AS (SELECT *, {_FLAGS} FROM lp_),
lb_ AS (SELECT u, t, m, p50, p70, p90, 'y' AS outcome, y AS v FROM lf_ UNION ALL SELECT u, t, m, p50, p70, p90, 'w', y * 0.95 FROM lf_),
ls_ AS (SELECT u, outcome, max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS ym, max(CASE WHEN m IS NULL THEN 1 ELSE 0 END) AS cm,
               CASE WHEN count(*) <> (SELECT count(DISTINCT t) FROM lf_) THEN 1 ELSE 0 END AS gap,
               max(CASE WHEN v > 0.85 THEN 1 ELSE 0 END) AS yh, avg(p50) AS p50, avg(p70) AS p70, avg(p90) AS p90 FROM lb_ GROUP BY u, outcome),
ll_ AS (SELECT exposure, outcome, u, ym + 2 * cm + 4 * gap + 8 * yh + CASE WHEN coalesce({_case_exp('')} <= 0.01, false) THEN 0 ELSE 16 END AS failed
        FROM ls_ CROSS JOIN (VALUES {", ".join(f"('{n}')" for n in _EXPS)}) e(exposure)),
lq_ AS (SELECT exposure, outcome, count(CASE WHEN failed = 0 THEN 1 END) AS donors,
               {", ".join(f"count(CASE WHEN failed & {b} <> 0 THEN 1 END) AS barred_{n}" for n, b in
                          (("missing_outcome", 1), ("missing_covariate", 2), ("gaps", 4), ("outcome_limit", 8), ("exposure_share", 16)))}
        FROM ll_ GROUP BY 1, 2),
le_ AS ({" UNION ALL ".join(f"SELECT u AS treated_unit, '{n}' AS exposure, min(t) AS event_time FROM lf_ WHERE {n} = 1 GROUP BY u" for n in _EXPS)}),
lg_ AS (SELECT DISTINCT e.exposure, CAST(n_nationkey AS INTEGER) AS treated_unit, o.outcome FROM nation JOIN region ON n_regionkey = r_regionkey
        CROSS JOIN (VALUES {", ".join(f"('{n}')" for n in _EXPS)}) e(exposure) CROSS JOIN (VALUES ('y'), ('w')) o(outcome)
        WHERE n_name IN {_ELIG} AND r_name = 'EUROPE'),
lr_ AS (SELECT lg_.*, ll_.failed AS treated_failed, le_.event_time, lq_.* EXCLUDE (exposure, outcome),
               coalesce(donors, 0) - CASE WHEN ll_.failed = 0 THEN 1 ELSE 0 END AS n_donors
        FROM lg_ LEFT JOIN lq_ USING (exposure, outcome)
        LEFT JOIN ll_ ON ll_.exposure = lg_.exposure AND ll_.outcome = lg_.outcome AND ll_.u = lg_.treated_unit
        LEFT JOIN le_ ON le_.treated_unit = lg_.treated_unit AND le_.exposure = lg_.exposure)""") + """
SELECT exposure, treated_unit, outcome, treated_failed, event_time, n_donors, barred_missing_outcome, barred_missing_covariate, barred_gaps,
       barred_outcome_limit, barred_exposure_share,
       CASE WHEN treated_failed IS NULL OR treated_failed & 7 <> 0 THEN 'no treated unit' WHEN event_time IS NULL THEN 'no event'
            WHEN n_donors = 0 THEN 'no donors' ELSE 'complete' END AS status
FROM lr_"""
