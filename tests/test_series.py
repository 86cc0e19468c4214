"""Golden micro-cases for the series, ratio and aggregate rules."""

import math

from pyspark.sql import functions as F

from panelfx import PanelSpec
from panelfx.functions import ratio, strict_sum, threshold_flag
from panelfx.operators import aggregate, events, series

SPEC = PanelSpec("u", "t")


def _series(spark, values, col="c"):
    return spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(values)], f"u int, t int, {col} bigint")


def _col(df, c):
    return [r[c] for r in df.orderBy("t").collect()]


def test_decumulate_first_total_and_zero(spark):
    df = _series(spark, [10, 13, 12, 11, 20])
    assert _col(series.decumulate(df, SPEC, "c", "total", "_d"), "c_d") == [10, 3, -1, -1, 9]
    assert _col(series.decumulate(df, SPEC, "c", "zero", "_d"), "c_d") == [0, 3, -1, -1, 9]


def test_repairs(spark):
    df = series.decumulate(_series(spark, [10, 13, 12, 11, 20]), SPEC, "c", "total", "_d")
    assert _col(series.repair_negative(df, SPEC, "c_d", "null", "_r"), "c_d_r") == [10, 3, None, None, 9]
    z = series.decumulate(_series(spark, [10, 13, 12, 11, 20]), SPEC, "c", "zero", "_d")
    # previous row's *original* value, no cascade: the second -1 stays -1
    assert _col(series.repair_negative(z, SPEC, "c_d", "previous", "_r"), "c_d_r") == [0, 3, 3, -1, 9]
    assert _col(series.repair_negative(z, SPEC, "c_d", "last_good", "_r"), "c_d_r") == [0, 3, 3, 3, 9]


def test_ratio_modes(spark):
    df = spark.createDataFrame([(0, 0), (3, 0), (3, 2), (None, 0), (-1, 0)], "n bigint, d bigint")
    ieee = [r[0] for r in df.select(ratio("n", "d", "ieee")).collect()]
    assert math.isnan(ieee[0]) and ieee[1] == math.inf and ieee[2] == 1.5 and ieee[3] is None
    assert ieee[4] == -math.inf
    assert [r[0] for r in df.select(ratio("n", "d", "null")).collect()] == [None, None, 1.5, None, None]


def test_interpolate_single_gaps_only(spark):
    df = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate([10.0, None, 20.0, None, None, 50.0])],
                               "u int, t int, c double")
    assert _col(series.interpolate_gap(df, SPEC, "c"), "c") == [10.0, 15.0, 20.0, None, None, 50.0]


def test_rolling_sum_and_lagged_mean(spark):
    df = _series(spark, list(range(1, 17)))
    assert _col(series.rolling_sum(df, SPEC, "c", 7), "c_roll7") == [None] * 6 + [28 + 7 * i for i in range(10)]
    lm = _col(series.lagged_mean(df, SPEC, "c", 14, 8, out="m"), "m")
    assert lm == [None] * 14 + [4.0, 5.0]


def test_rolling_sum_propagates_null(spark):
    df = spark.createDataFrame([(1, i + 1, None if i == 8 else 1) for i in range(16)], "u int, t int, c bigint")
    out = _col(series.rolling_sum(df, SPEC, "c", 7), "c_roll7")
    assert out[6:8] == [7, 7] and out[8:15] == [None] * 7 and out[15] == 7


def test_first_exposure_cut70(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 2, 75.0), (1, 3, 80.0), (2, 1, 70.0), (3, 1, None), (3, 2, 5.0)],
                               "u int, t int, dose double").withColumn("f", threshold_flag("dose", 70))
    got = {r["u"]: r["f70"] for r in events.first_exposure_wide(df, SPEC, {"f70": "f"}).collect()}
    assert got == {1: 2, 2: 1, 3: None}


def test_strict_sum(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (1, 3)], "g int, x bigint")
    assert df.groupBy("g").agg(strict_sum("x").alias("s")).first()["s"] is None
    assert aggregate.group_agg(df, ["g"], {"s": ("sum", "x")}).first()["s"] == 4


def test_mark_first_exposure(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 1, 0)], "u int, t int, f int")
    rows = {(r["u"], r["t"]): (r["first_e"], r["e_day1"])
            for r in events.mark_first_exposure(df, SPEC, {"e": "f"}).collect()}
    assert rows == {(1, 1): (None, None), (1, 2): (1, 2), (1, 3): (None, None), (2, 1): (None, None)}


def test_threshold_flag_nan_and_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (50.0,), (49.9,)], "x double")
    assert [r[0] for r in df.select(threshold_flag("x", 50)).collect()] == [None, None, 1, 0]
    assert df.filter(F.isnan("x") & (F.col("x") > 1)).count() == 1   # Spark: NaN > 1 is true; flags guard NaN
