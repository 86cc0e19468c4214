"""Sources and sinks: wide/long CSV, stages, partitioned stages with dynamic overwrite."""

import os
import tempfile

import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelfx.sources.io import export_csv, read_csv, read_stage, read_wide_csv, write_stage

ID = T.StructType([T.StructField("countyfips", T.LongType()), T.StructField("countyname", T.StringType())])


def _scratch():
    return tempfile.mkdtemp(prefix="panelfx-io-", dir="/tmp")


def test_wide_csv_ids_typed_values_cast(spark):
    d = _scratch()
    p = os.path.join(d, "w.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("countyfips,countyname,v5,v6\n1,Ståd County,3,x\n2,B,,7\n")
    df = read_wide_csv(spark, p, ID)
    assert dict(df.dtypes) == {"countyfips": "bigint", "countyname": "string", "v5": "bigint", "v6": "bigint"}
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [(1, "Ståd County", 3, None), (2, "B", None, 7)]


def test_long_csv_with_schema(spark):
    d = _scratch()
    p = os.path.join(d, "l.csv")
    with open(p, "w") as f:
        f.write("geoid,dates,heavy_pct\n6001,20200708,95.5\n6001,bad,\n")
    df = read_csv(spark, p, "geoid long, dates long, heavy_pct double")
    got = sorted(((r["geoid"], r["dates"], r["heavy_pct"]) for r in df.collect()), key=str)
    assert got == [(6001, 20200708, 95.5), (6001, None, None)]


def test_partitioned_stage_dynamic_overwrite(spark):
    root = _scratch()
    a = spark.createDataFrame([("e1", 1, 1.0), ("e2", 1, 2.0)], "exposure string, u int, y double")
    write_stage(a, root, "coh", partition_by=["exposure"])
    b = spark.createDataFrame([("e2", 2, 9.0)], "exposure string, u int, y double")
    write_stage(b, root, "coh", partition_by=["exposure"])          # replaces only partition e2
    got = sorted((r["exposure"], r["u"], r["y"]) for r in read_stage(spark, root, "coh").collect())
    assert got == [("e1", 1, 1.0), ("e2", 2, 9.0)]


def test_stage_refuses_to_overwrite_its_input(spark):
    root = _scratch()
    write_stage(spark.range(3), root, "s")
    df = read_stage(spark, root, "s").withColumn("x", F.lit(1))
    try:
        write_stage(df, root, "s")
        raise AssertionError("expected refusal")
    except ValueError:
        pass


def test_export_csv_header(spark):
    out = os.path.join(_scratch(), "rep")
    export_csv(spark.createDataFrame([(1, "a")], "k int, v string"), out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["k", "v"] and back.count() == 1


def test_wide_csv_long_reads_fields_as_the_reader_does(spark, tmp_path):
    """Quotes, commas and quotes inside them, empty and missing fields, text that does not parse, two
    part files with a header each: the same rows as the column-wise reader and unpivot."""
    from panelfx.operators.panel import wide_to_long
    from panelfx.sources.io import read_wide_csv, read_wide_csv_long
    (tmp_path / "a.csv").write_text('id,name,v5,v6,extra,v9\n1,"Doe, J",1,2,x,3\n2,"say ""hi""",,-4,,5\n3,plain,7,8,y,\n\n4,,9,bad,z,10\n')
    (tmp_path / "b.csv").write_text('id,name,v5,v6,extra,v9\n5,"",11,12,"q,r",13\n6,"""",1\n7,"a\\"b",2,3,,4\n')
    ids = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    got = read_wide_csv_long(spark, str(tmp_path), ids, "v", "day", "n")
    assert got.dtypes == [("id", "bigint"), ("name", "string"), ("day", "int"), ("n", "bigint")]
    rows = sorted(tuple(r) for r in got.collect())
    by = {(r[0], r[2]): (r[1], r[3]) for r in rows}
    assert len(rows) == 21 and by[1, 9] == ("Doe, J", 3) and by[2, 5] == ('say "hi"', None) and by[2, 6][1] == -4
    assert by[3, 9][1] is None and by[4, 6] == (None, None) and by[5, 5] == ("", 11) and by[6, 6] == ('"', None) and by[7, 9] == ('a"b', 4)
    plain = wide_to_long(read_wide_csv(spark, str(tmp_path / "a.csv"), ids).drop("extra"), ["id", "name"], "v", "day", "n")
    key = lambda r: (r[0], r[2])
    assert sorted((r for r in rows if r[0] <= 4 and r[0] != 2), key=key) == sorted((tuple(r) for r in plain.filter("id <> 2").collect()), key=key)


def test_wide_csv_long_of_twenty_thousand_columns(spark, tmp_path):
    from panelfx.sources.io import read_wide_csv_long
    n = 20_000
    lines = ["u," + ",".join(f"v{i}" for i in range(n))] + [f"{u}," + ",".join(str(u * i) for i in range(n)) for u in range(3)]
    (tmp_path / "wide.csv").write_text("\n".join(lines) + "\n")
    got = read_wide_csv_long(spark, str(tmp_path / "wide.csv"), T.StructType([T.StructField("u", T.IntegerType())]), "v", "day", "n")
    assert got.count() == 3 * n and got.filter("n <> u * day OR n IS NULL").count() == 0
    nodes = got._jdf.queryExecution().optimizedPlan().treeString().count("\n")
    assert nodes < 12 and len(got.columns) == 3


def test_stage_survives_a_job_that_dies(spark, tmp_path):
    root = str(tmp_path)
    write_stage(spark.range(5), root, "s")
    bad = spark.range(9).withColumn("x", F.when(F.col("id") < 8, 1).otherwise(F.raise_error(F.lit("dies")).cast("int")))
    with pytest.raises(Exception, match="dies"):
        write_stage(bad, root, "s")
    assert read_stage(spark, root, "s").count() == 5
    write_stage(spark.range(7), root, "s")
    assert read_stage(spark, root, "s").count() == 7
    os.rename(os.path.join(root, "s"), os.path.join(root, "s.aside"))          # died between the renames
    assert read_stage(spark, root, "s").count() == 7
    write_stage(spark.range(2), root, "s")
    assert read_stage(spark, root, "s").count() == 2
