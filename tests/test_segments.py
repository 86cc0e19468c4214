"""Time segments against whole-unit windows; gap runs; the rule ledger."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelfx import PanelSpec
from panelfx.operators import panel, segments, series

SPEC = PanelSpec("u", "t")


def rows(spark, n=400, seed=1):
    """One unit with most of the rows, short ones, and one whose unit is null."""
    rng = random.Random(seed)
    times = {u: rng.sample(range(10 * n), n if u == 0 else 7) for u in [0, 1, 2, None]}
    data = [(u, t, rng.choice([None, -3, -1, 0, 2, 5]), rng.randrange(100)) for u, ts in times.items() for t in ts]
    return spark.createDataFrame(data, "u int, t int, x int, y int").repartition(4)


@pytest.mark.parametrize("length", [15, 64, 10_000])
def test_segments_equal_whole_windows(spark, length):
    df = rows(spark)
    build = lambda s: {
        "total": series.decumulate_expr(s, "y", "total"), "zero": series.decumulate_expr(s, "y", "zero"), "null": series.repair_negative_expr(s, "x", "null"),
        "prev": series.repair_negative_expr(s, "x", "previous"), "lag": series.lag_expr(s, "y", 14), "mean": series.lagged_mean_expr(s, "y", 14, 8),
        "roll": series.rolling_sum_expr(s, "x", 7), "fill": series.interpolate_gap_expr(s, "x")}
    want = df.withColumns(build(SPEC)).withColumns({
        "cum": F.sum("x").over(SPEC.frame(Window.unboundedPreceding, 0)), "good": series.repair_negative_expr(SPEC, "x", "last_good")})
    got = segments.numbered(df, SPEC, length)
    assert got.agg(F.max("__seg")).first()[0] == 399 // length
    got = segments.repair_last_good(segments.running_total(got, SPEC, "x", "cum"), SPEC, "x", "good")
    got = segments.over_segments(got, SPEC, build, back=14, ahead=1, length=length).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_long_unit_is_many_tasks(spark):
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    try:
        got = segments.numbered(rows(spark), SPEC, 20)
        out = segments.over_segments(got, SPEC, lambda s: {"roll": series.rolling_sum_expr(s, "x", 7)}, back=6, length=20)
        assert out.filter("u = 0").select(F.spark_partition_id().alias("p")).distinct().count() == 4
    finally:
        spark.conf.set(merge, "true")
    with pytest.raises(ValueError, match="halo"):
        segments.over_segments(got, SPEC, lambda s: {}, back=21, length=20)


def test_gap_runs(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 7), (2, 4), (3, 1), (3, 9), (4, None), (5, 3), (5, None)], "u int, t int")
    got = sorted(tuple(r) for r in panel.gap_runs(df, SPEC).collect())
    assert got == [(1, 3, 6, 4), (1, 8, 9, 2), (2, 1, 3, 3), (2, 5, 9, 5), (3, 2, 8, 7), (4, 1, 9, 9), (5, 1, 2, 2), (5, 4, 9, 6)]
    assert panel.panel_gaps(df, SPEC).count() == sum(g[3] for g in got)
    d = lambda n: dt.date(2020, 2, n)
    days = spark.createDataFrame([(1, d(27)), (1, dt.date(2020, 3, 2)), (2, d(28))], "u int, t date")
    assert sorted(tuple(r) for r in panel.gap_runs(days, SPEC).collect()) == [
        (1, d(28), dt.date(2020, 3, 1), 3), (2, d(27), d(27), 1), (2, d(29), dt.date(2020, 3, 2), 3)]
    assert panel.gap_runs(df.limit(0), SPEC).collect() == [] and panel.complete_panel(df.limit(0), SPEC).collect() == []


def test_every_rule_and_status_occurs_in_the_ledger(spark):
    import __spark_entry__ as E
    got = E.queries()["cohort_ledger"](spark, "/root/testdata/sf0.01").collect()
    assert {r.status for r in got} >= {"no treated unit", "complete"}
    for rule in ("missing_outcome", "missing_covariate", "gaps", "outcome_limit", "exposure_share"):
        assert max(r[f"barred_{rule}"] for r in got) > 0, rule
