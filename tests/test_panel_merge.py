"""Reshape, completion, ids and merge rules."""

from pyspark.sql import functions as F

from panelfx import PanelSpec
from panelfx.operators import merge, panel

SPEC = PanelSpec("u", "t")


def test_wide_to_long_keeps_nulls(spark):
    wide = spark.createDataFrame([(1, "a", 5, None), (2, "b", None, 7)], "id int, name string, v5 int, v6 int")
    long = panel.wide_to_long(wide, ["id", "name"], "v", "day", "total")
    assert sorted(tuple(r) for r in long.collect()) == [(1, "a", 5, 5), (1, "a", 6, None), (2, "b", 5, None),
                                                          (2, "b", 6, 7)]


def test_complete_panel_and_gaps(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 3, 6), (2, 2, 7)], "u int, t int, n bigint")
    full = panel.complete_panel(df, SPEC, fill={"n": 0}, flag="added")
    got = sorted((r["u"], r["t"], r["n"], r["added"]) for r in full.collect())
    assert got == [(1, 1, 5, 0), (1, 2, 0, 1), (1, 3, 6, 0), (2, 1, 0, 1), (2, 2, 7, 0), (2, 3, 0, 1)]
    assert sorted(tuple(r) for r in panel.panel_gaps(df, SPEC).collect()) == [(1, 2), (2, 1), (2, 3)]


def test_dense_ids_global_and_within(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", "x"), ("a", "y"), ("d", "y")] * 3, "k string, g string")
    ids = {r["k"]: r["id"] for r in panel.dense_ids(df, ["k"]).collect()}
    assert ids == {"a": 1, "b": 2, "c": 3, "d": 4}
    w = {(r["g"], r["k"]): r["id"] for r in panel.dense_ids(df, ["k"], within=["g"]).collect()}
    assert w == {("x", "b"): 1, ("x", "c"): 2, ("y", "a"): 1, ("y", "d"): 2}


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "u int, t int")
    assert [tuple(r) for r in panel.duplicate_keys(df, ["u", "t"]).collect()] == [(1, 1, 2)]


def test_recode_dict_and_table(spark):
    df = spark.createDataFrame([("Matthews County",), ("Other",), (None,)], "name string")
    a = [r["name"] for r in panel.recode(df, "name", {"Matthews County": "Mathews County"}).collect()]
    assert a == ["Mathews County", "Other", None]
    m = spark.createDataFrame([("Other", "X")], "f string, to string")
    assert sorted(str(r["name"]) for r in panel.recode(df, "name", m).collect()) == ["Matthews County", "None", "X"]


def test_merge_left_value_wins_even_if_null(spark):
    left = spark.createDataFrame([(1, None, 10), (2, 5, 20)], "k int, shared int, lonly int")
    right = spark.createDataFrame([(1, 99, "a"), (3, 7, "c")], "k int, shared int, ronly string")
    out = {r["k"]: tuple(r) for r in merge.merge_one_to_one(left, right, ["k"], "all", indicator="m").collect()}
    assert out[1] == (1, None, 10, "a", 3)       # left row exists: its null wins
    assert out[2] == (2, 5, 20, None, 1)
    assert out[3] == (3, 7, None, "c", 2)        # right-only row: right value
    assert merge.merge_one_to_one(left, right, ["k"], "match").count() == 1
    assert merge.merge_one_to_one(left, right, ["k"], "left").count() == 2


def test_null_safe_natural_join(spark):
    left = spark.createDataFrame([(1, None), (2, 3.0)], "a int, b double")
    right = spark.createDataFrame([(1, None, "hit"), (2, 3.0, "hit2")], "a int, b double, v string")
    got = sorted(tuple(r) for r in merge.natural_left_join(left, right, null_safe=True).collect())
    assert got == [(1, None, "hit"), (2, 3.0, "hit2")]
    plain = sorted(str(r["v"]) for r in merge.natural_left_join(left, right).collect())
    assert plain == ["None", "hit2"]


def test_append_union_of_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3, "z")], "x int, w string")
    rows = sorted(merge.append(a, b).collect(), key=lambda r: r["x"])
    assert (rows[0]["w"], rows[1]["y"]) == (None, None)


def test_anti_join(spark):
    df = spark.createDataFrame([(1, 1), (2, 1)], "u int, t int")
    bad = spark.createDataFrame([(2,)], "u int")
    assert [r["u"] for r in merge.drop_matching(df, bad, ["u"]).collect()] == [1]
    assert F is not None


def test_merge_fails_on_duplicate_keys_when_it_runs(spark):
    import pytest
    left = spark.createDataFrame([(1, 1), (1, 2)], "k int, a int")
    right = spark.createDataFrame([(1, 3)], "k int, b int")
    for keep in ("all", "match", "left", "right"):
        for a, b, side in ((left, right, "left"), (right, left, "right")):
            merged = merge.merge_one_to_one(a, b, ["k"], keep)
            with pytest.raises(Exception, match=f"not unique on the {side} side") as e:
                merged.select("k").collect()                # the check survives column pruning
            assert '{"k":1}' in str(e.value)
    assert merge.merge_one_to_one(right, right.withColumnRenamed("b", "c"), ["k"], validate=True).count() == 1
    twice = spark.createDataFrame([(None, 1), (None, 2)], "k int, a int")       # two null keys are duplicates
    with pytest.raises(Exception, match="not unique"):
        merge.merge_one_to_one(twice, right, ["k"]).collect()


def test_merge_matches_null_keys(spark):
    import datetime as dt
    left = spark.createDataFrame([(None, 1, "a"), (0, 1, "b"), (2, None, None)], "k int, t int, x string")
    right = spark.createDataFrame([(None, 1, "A"), (0, 2, "B"), (2, None, "C")], "k long, t int, y string")
    got = sorted((tuple(r) for r in merge.merge_one_to_one(left, right, ["k", "t"], "all", indicator="m").collect()), key=str)
    assert got == [(0, 1, "b", None, 1), (0, 2, None, "B", 2), (2, None, None, "C", 3), (None, 1, "a", "A", 3)]
    assert merge.merge_one_to_one(left, right, ["k", "t"], "match").count() == 2
    for kind, one in (("string", ""), ("date", dt.date(1970, 1, 1)), ("boolean", False), ("double", 0.0), ("decimal(5,2)", None)):
        a = spark.createDataFrame([(None, 1), (one, 2)] if one is not None else [(None, 1)], f"k {kind}, x int")
        b = spark.createDataFrame([(None, 3)], f"k {kind}, y int")
        assert [tuple(r) for r in merge.merge_one_to_one(a, b, ["k"], "match").collect()] == [(None, 1, 3)]


def test_merge_reuses_the_exchange_of_its_check(spark):
    """One exchange per side: the check's window and the join share it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = (spark.range(5, 100).selectExpr("if(id > 5, id, null) AS k", f"id AS {c}") for c in "ab")
        merged = merge.merge_one_to_one(left, right, ["k"], "all")
        assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert merged.count() == 95
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_insert_listed_times_only(spark):
    import datetime as dt
    spec = PanelSpec("u", "d")
    df = spark.createDataFrame([(1, dt.date(2020, 7, 7), 1.0), (1, dt.date(2020, 7, 9), 3.0),
                                (2, dt.date(2020, 7, 1), 5.0)], "u int, d date, x double")
    out = panel.insert_times(df, spec, [dt.date(2020, 7, 8)])
    got = sorted((r["u"], r["d"].isoformat(), r["x"]) for r in out.collect())
    assert got == [(1, "2020-07-07", 1.0), (1, "2020-07-08", None), (1, "2020-07-09", 3.0),
                   (2, "2020-07-01", 5.0), (2, "2020-07-08", None)]
