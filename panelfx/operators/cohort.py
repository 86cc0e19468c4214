"""Treated/donor cohorts for a whole grid of (exposure, treated unit, outcome) at once
(J9, W12, E3, E4, F4-F6, G5, P16 inside cohorts; E5 end to end).

Instead of one pass per grid cell, the grid is a table and every rule is a join or
an aggregate keyed by it:

* unit-level facts (any missing outcome, any outcome above the limit, any missing
  covariate, share of exposed times, first time) are aggregated once per unit and
  outcome -- partial aggregation, so a hot unit is pre-combined per task;
* the donor rules depend on exposure and outcome alone, so donors, their ids and their
  first time are found once for each of those, and so are the donors' panel rows;
* a cohort differs from them by its treated unit alone: where that is no donor, the ids
  after it move up by one; where it is one, its own rows take the place of the donor's.

Cohorts times donors exist only in the rows returned, which stream from the donors' rows past
the (broadcast) cohorts, kept as arrays: no (cohort, unit) table is written, sorted or shuffled.
A row is made by one join and one inline, without a union behind them, so that an aggregate of
the rows runs in the same generated loop. Nothing is collected to the driver and no step holds
more than one unit's series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratio import finite_or_null
from ..functions.scalar import post_flag
from ..session import materialize
from ..spec import PanelSpec
from .events import first_exposure
from .ranks import rank_counts

COHORT_KEYS = ["exposure", "treated_unit", "outcome"]
TASK_ROWS = 20_000_000      # rows a task of the returned table makes, about; a quarter while cores would be idle
ARRAY_COHORTS = 1_000       # cohorts in one array, about


@dataclass(frozen=True)
class CohortRules:
    """Donor/unit rules, in the order they are applied.

    drop_missing_outcome  F4: a unit with any missing outcome leaves the cohort (treated too)
    drop_gaps             F4/Y1: a unit without a row at any time the panel has leaves (treated
                          too), so that all units of a cohort have the same predictors
    covariate             F4: a unit with any missing covariate leaves the cohort (treated too)
    outcome_limit         F5: a donor with any outcome above this leaves (treated exempt)
    max_share             F6: a donor whose share of exposed times exceeds this leaves
                          (treated exempt); a donor with no known exposure leaves too
    """

    drop_missing_outcome: bool = True
    drop_gaps: bool = True
    covariate: str | None = None
    outcome_limit: float | None = 1.0
    max_share: float | None = 0.01


def cohort_grid(treated: DataFrame, unit: str, exposures: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """(exposure, treated_unit, outcome) for every treated unit in `treated`
    (a data-derived table, e.g. the units flagged eligible) and every listed
    exposure definition and outcome."""
    return (treated.select(F.col(unit).alias("treated_unit")).distinct()
            .select(F.explode(F.array(*[F.lit(e) for e in exposures])).alias("exposure"), "treated_unit",
                    F.explode(F.array(*[F.lit(o) for o in outcomes])).alias("outcome")))


def _pick(name_col: Column, mapping: Mapping[str, Column]) -> Column:
    """Value of the column that `name_col` names (a CASE over a short, fixed list)."""
    e = None
    for name, c in mapping.items():
        e = (F.when(name_col == name, c) if e is None else e.when(name_col == name, c))
    return e


def _unit_time(spec: PanelSpec) -> tuple[str, str]:
    if len(spec.unit) != 1:
        raise ValueError("cohorts need a single unit column")
    return spec.unit[0], spec.time


def unit_facts(panel: DataFrame, spec: PanelSpec, outcomes: Sequence[str], flags: Mapping[str, str], rules: CohortRules,
               carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """What the donor rules look at: the panel long in the outcomes, facts per unit and outcome (F4,
    F5), facts per unit (F4 covariate, F6, first time), and the number of times the panel has."""
    u, t = _unit_time(spec)
    cov = rules.covariate
    keep_cols = [u, t, *([cov] if cov else []), *flags.values(), *carry]
    base = (panel.select(*keep_cols, *outcomes)
            .unpivot([*keep_cols], list(outcomes), "outcome", "Y")
            .withColumn("Y", finite_or_null(F.col("Y").cast("double"))))
    # a unit-time row that is absent from the panel counts as a missing value
    n_times = panel.select(t).distinct().count() if rules.drop_gaps else 0
    ystats = base.groupBy(u, "outcome").agg(
        F.count(F.lit(1)).alias("__rows"), F.max(F.col("Y").isNull().cast("int")).alias("__y_missing"),
        (F.max(F.coalesce((F.col("Y") > rules.outcome_limit).cast("int"), F.lit(0)))
         if rules.outcome_limit is not None else F.lit(0)).alias("__y_high"))
    uaggs = [F.min(t).alias("__t0")]
    if cov:
        uaggs.append(F.max(F.col(cov).isNull().cast("int")).alias("__cov_missing"))
    uaggs += [F.avg(F.col(c).cast("double")).alias(f"__share_{n}") for n, c in flags.items()]
    return base, ystats, panel.groupBy(u).agg(*uaggs), n_times


def rule_columns(rules: CohortRules, share: Column, n_times: int) -> tuple[Column, Column]:
    """Whether a unit may be in a cohort at all, and whether it may be a donor."""
    ok = donor_ok = F.lit(True)
    if rules.drop_missing_outcome:
        ok = ok & (F.col("__y_missing") == 0)
    if rules.covariate:
        ok = ok & (F.col("__cov_missing") == 0)
    if rules.drop_gaps:
        ok = ok & (F.col("__rows") == n_times)
    if rules.outcome_limit is not None:
        donor_ok = donor_ok & (F.col("__y_high") == 0)
    if rules.max_share is not None:
        donor_ok = donor_ok & F.coalesce(share <= rules.max_share, F.lit(False))
    return ok, donor_ok


def build_cohorts(panel: DataFrame, spec: PanelSpec, grid: DataFrame, outcomes: Sequence[str],
                  exposure_flags: Mapping[str, str], rules: CohortRules = CohortRules(),
                  events: DataFrame | None = None, carry: Sequence[str] = (), event_shift: int = 0,
                  broadcast_cohorts: int = 200_000) -> DataFrame:
    """E5: one long table of all cohorts.

    panel           unit-time rows with the outcome columns, the covariate and one 0/1
                    flag column per exposure definition (`exposure_flags`: name -> column)
    grid            (exposure, treated_unit, outcome) rows, e.g. from `cohort_grid`
    events          (unit, definition, event_time) first exposures; by default computed
                    from the panel's flags (E1)
    carry           extra panel columns to keep (e.g. labels)
    event_shift     added to every event time (0: one time axis; a nonzero shift reproduces
                    an analysis whose event times were taken on a different axis)
    broadcast_cohorts  the grid is broadcast up to so many rows; a larger one is dealt to
                    salted blocks of one array each, so that joining on the few distinct values
                    of exposure and outcome does not send all their donors to one task

    Columns: exposure, treated_unit, outcome, <unit>, <time>, Y, <covariate>, X (post
    period of the treated unit's event, E3), treated (E4), exposed (the cohort's flag),
    avg_exposed (F6 share), event_time (W12), day_one (G5), id (dense unit id within
    the cohort, P16). Outcomes pass `finite_or_null` first (NaN/Inf are missing).
    """
    u, t = _unit_time(spec)
    cov = rules.covariate
    flags = dict(exposure_flags)
    base, ystats, ustats, n_times = unit_facts(panel, spec, outcomes, flags, rules, carry)

    if events is None:
        events = first_exposure(panel, spec, flags, "definition", "event_time")
    ev = events.select(F.col(u).alias("treated_unit"), F.col("definition").alias("exposure"),
                       (F.col("event_time") + F.lit(event_shift)).alias("event_time"))
    pool = ["exposure", "outcome"]
    # a cohort whose exposure, treated unit or outcome is null has no rows
    grid = materialize(grid.select(*COHORT_KEYS).dropna(subset=COHORT_KEYS), "grid")

    # units that may be in a cohort, once per exposure and outcome: donor or not, and the donors before them
    kinds = grid.select(*pool).distinct()
    facts = ystats.join(ustats, u).join(kinds, "outcome")
    share = _pick(F.col("exposure"), {n: F.col(f"__share_{n}") for n in flags})
    ok, donor_ok = rule_columns(rules, share, n_times)
    facts = materialize(facts.filter(ok).select(*pool, u, share.alias("avg_exposed"), donor_ok.alias("__donor"), "__t0"), "facts")
    donors = facts.filter("__donor")
    facts = rank_counts(donors, facts, pool, u).withColumn("id", (F.col("n_below") + 1).cast("int")).drop("n_below", "n_upto", "n_points")
    facts = materialize(facts, "ranked")
    first = donors.groupBy(*pool).agg(F.min("__t0").alias("__pool_t0"))
    own = facts.select(*pool, F.col(u).alias("treated_unit"), "avg_exposed", "__t0", "id", F.col("__donor"))
    g = grid.join(ev, ["treated_unit", "exposure"], "left").join(own, COHORT_KEYS, "left").join(first, pool, "left")
    g = g.withColumn("day_one", F.least("__pool_t0", "__t0")).withColumn("__extra", F.coalesce(~F.col("__donor"), F.lit(False)))
    g = materialize(g.drop("__pool_t0", "__t0", "__donor"), "cohorts")

    # the rows of donors and, for their own cohorts alone, of treated units that are none (`__own`)
    extra = g.filter("__extra").select(*pool, F.col("treated_unit").alias(u)).distinct().withColumn("__asked", F.lit(True))
    rows = facts.join(extra, [*pool, u], "left").filter("__donor OR __asked")
    rows = rows.select(*pool, u, "avg_exposed", F.col("id").alias("__rank"), F.when(~F.col("__donor"), F.col(u)).alias("__own"))
    rows = rows.join(base, [u, "outcome"]).withColumn("__exposed", _pick(F.col("exposure"), {n: F.col(c) for n, c in flags.items()}))
    rows = materialize(rows.select(*dict.fromkeys([*pool, u, t, "Y", *([cov] if cov else []), "avg_exposed", *carry, "__rank", "__own", "__exposed"])), "donors")

    total, most = g.groupBy(*pool).count().agg(F.sum("count"), F.max("count")).first()
    total, most = total or 0, most or 0
    arrays = max(1, -(-most // min(ARRAY_COHORTS, broadcast_cohorts)))
    g = g.select(*pool, F.pmod(F.xxhash64("exposure", "treated_unit"), F.lit(arrays)).cast("int").alias("__block"), "treated_unit", "event_time", "day_one", "__extra")
    g = g.withColumn("__own", F.lit(None).cast(g.schema["treated_unit"].dataType)) \
        .unionByName(g.filter("__extra").withColumn("__own", F.col("treated_unit")))
    g = g.groupBy(*pool, "__own", "__block").agg(F.collect_list(F.struct("treated_unit", "event_time", "day_one", "__extra")).alias("__cohorts"))
    on = pool
    if total <= broadcast_cohorts:
        made = rows.count() * most
        cores = rows.sparkSession.sparkContext.defaultParallelism
        tasks = max(-(-made // TASK_ROWS), min(-(-4 * made // TASK_ROWS), cores))
        if tasks > 1:
            rows = rows.repartition(tasks, u, t)
        g = F.broadcast(g.drop("__block"))
    else:
        on = [*pool, "__block"]
        rows = rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(arrays - 1))))
    g = g.withColumnsRenamed({c: f"__g_{c}" for c in [*on, "__own"]})
    same = rows["__own"].eqNullSafe(g["__g___own"])
    for c in on:
        same = same & (rows[c] == g[f"__g_{c}"])
    m = rows.join(g, same).select(*rows.columns, F.inline("__cohorts"))
    treated = F.when(F.col(u) == F.col("treated_unit"), 1).otherwise(0)
    after = F.col("__extra") & (F.col(u) > F.col("treated_unit"))
    return m.select(*COHORT_KEYS, u, t, "Y", *([cov] if cov else []), post_flag(t, "event_time").alias("X"), treated.alias("treated"),
                    F.col("__exposed").alias("exposed"), "avg_exposed", "event_time", "day_one", (F.col("__rank") + after.cast("int")).alias("id"), *carry)


# The rules a unit can fail, as bits of a ledger entry, in the order they are applied.
RULE_BITS = {"missing_outcome": 1, "missing_covariate": 2, "gaps": 4, "outcome_limit": 8, "exposure_share": 16}
MEMBER_BITS = 7          # a unit that fails one of these is in no cohort; the others bar it as a donor


def rule_ledger(panel: DataFrame, spec: PanelSpec, outcomes: Sequence[str], exposure_flags: Mapping[str, str],
                rules: CohortRules = CohortRules()) -> DataFrame:
    """(exposure, outcome, unit, failed): per exposure and outcome the rules each unit fails, a bit
    set of `RULE_BITS`. A cohort's donors are the units with failed = 0, so the ledger of a cohort is
    that of its exposure and outcome: rows do not grow with the treated units."""
    u, _ = _unit_time(spec)
    flags = dict(exposure_flags)
    _, ystats, ustats, n_times = unit_facts(panel, spec, outcomes, flags, rules)
    m = ystats.join(ustats, u).withColumn("exposure", F.explode(F.array(*[F.lit(n) for n in flags])))
    share = _pick(F.col("exposure"), {n: F.col(f"__share_{n}") for n in flags})
    fails = {"missing_outcome": rules.drop_missing_outcome and F.col("__y_missing") == 1,
             "missing_covariate": bool(rules.covariate) and F.col("__cov_missing") == 1,
             "gaps": rules.drop_gaps and F.col("__rows") != n_times,
             "outcome_limit": rules.outcome_limit is not None and F.col("__y_high") == 1,
             "exposure_share": rules.max_share is not None and ~F.coalesce(share <= rules.max_share, F.lit(False))}
    bits = sum((F.when(c, F.lit(RULE_BITS[n])).otherwise(F.lit(0)) for n, c in fails.items() if c is not False), F.lit(0))
    return m.select("exposure", "outcome", u, bits.alias("failed"))


def cohort_ledger(panel: DataFrame, spec: PanelSpec, grid: DataFrame, outcomes: Sequence[str], exposure_flags: Mapping[str, str],
                  rules: CohortRules = CohortRules(), events: DataFrame | None = None) -> DataFrame:
    """One row for every cohort of the grid, those that cannot be estimated included: the rules its
    treated unit fails (null where the panel lacks it), its event time, its donors, the units each rule
    bars from being one, and a status -- "no treated unit" (not in the panel, or lost to a rule for
    all units), "no event", "no donors" or "complete"."""
    u, _ = _unit_time(spec)
    ledger = materialize(rule_ledger(panel, spec, outcomes, exposure_flags, rules), "ledger")
    per = ledger.groupBy("exposure", "outcome").agg(
        F.sum((F.col("failed") == 0).cast("long")).alias("__donors"),
        *[F.sum((F.col("failed").bitwiseAND(bit) != 0).cast("long")).alias(f"barred_{n}") for n, bit in RULE_BITS.items()])
    if events is None:
        events = first_exposure(panel, spec, dict(exposure_flags), "definition", "event_time")
    ev = events.select(F.col(u).alias("treated_unit"), F.col("definition").alias("exposure"), "event_time")
    own = ledger.select("exposure", "outcome", F.col(u).alias("treated_unit"), F.col("failed").alias("treated_failed"))
    out = grid.join(per, ["exposure", "outcome"], "left").join(own, COHORT_KEYS, "left").join(ev, ["treated_unit", "exposure"], "left")
    out = out.withColumn("n_donors", F.coalesce("__donors", F.lit(0)) - F.when(F.col("treated_failed") == 0, 1).otherwise(0))
    lost = F.col("treated_failed").isNull() | (F.col("treated_failed").bitwiseAND(MEMBER_BITS) != 0)
    status = F.when(lost, "no treated unit").when(F.col("event_time").isNull(), "no event") \
        .when(F.col("n_donors") == 0, "no donors").otherwise("complete")
    return out.select(*COHORT_KEYS, "treated_failed", "event_time", "n_donors", *[f"barred_{n}" for n in RULE_BITS], status.alias("status"))


def cohort_bounds(cohorts: DataFrame, t: str = "t") -> DataFrame:
    """Per cohort, the first time of the cohort (day_first) and the treated unit's
    event time (day_exp; null when the treated unit is never exposed)."""
    return cohorts.groupBy(*COHORT_KEYS).agg(F.min(t).alias("day_first"), F.min("event_time").alias("day_exp"))
