"""The driver's star-schema tables mapped onto a unit x week panel.

unit ``u`` = customer nation, time = ISO week of the order date (``t`` = weeks since
Monday 1994-12-26). Per (u, week):

  n     orders                                   (denominator series)
  k     orders with status 'F'                   (numerator series)
  delta +1 per order, -1 for priority '5-LOW'    (a step series that can go negative)
  mob   sum of order prices                      (covariate series)
  dose  exposure 0..100, high in a short window for the units of one region

Everything is a declarative plan: the orders scan prunes to five columns, the
customer side is joined on its key (broadcast only when Spark's size check allows
it; sort-merge otherwise, with AQE splitting a hot customer key), and the
aggregation is partial-then-final so a nation holding a third of all orders is
pre-combined per map task before the shuffle.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import week_start
from ..spec import PanelSpec
from .io import read_table

# Fixed values of the test-panel definition.
WEEK0 = _dt.date(1994, 12, 26)           # Monday; t = 0
EXPOSED_REGION = "EUROPE"
EXPOSED_NATIONS = ["NATION_3", "NATION_8", "NATION_13", "NATION_18", "NATION_23"]

SPEC = PanelSpec("u", "t")


def week_index(wk) -> Column:
    """Weeks since WEEK0 for a Monday date."""
    c = F.col(wk) if isinstance(wk, str) else wk
    return F.floor(F.datediff(c, F.lit(WEEK0.isoformat()).cast("date")) / 7).cast("int")


def dose_expr(u="u", t="t", n="n") -> Column:
    """Exposure: 60..100 for units u % 5 == 3 during weeks [200 + u, 205 + u), else (7 n) mod 40."""
    u, t, n = F.col(u), F.col(t), F.col(n)
    hot = (u % 5 == 3) & (t >= u + 200) & (t < u + 205)
    return F.when(hot, F.lit(60.0) + (t % 5).cast("double") * 10.0).otherwise(((n * 7) % 40).cast("double"))


def _order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders",
                   ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    return o.join(c, o.o_custkey == c.c_custkey)


def _measures() -> list[Column]:
    return [
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).cast("bigint").alias("k"),
        F.sum(F.when(F.col("o_orderpriority") == "5-LOW", -1).otherwise(1)).cast("bigint").alias("delta"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("mob"),
    ]


def order_panel(spark: SparkSession, sf_dir: str, with_dose: bool = True) -> DataFrame:
    """(u, wk, n, k, delta, mob, t[, dose]) -- one row per unit-week that has orders."""
    g = (_order_facts(spark, sf_dir)
         .groupBy(F.col("c_nationkey").cast("int").alias("u"), week_start("o_orderdate").alias("wk"))
         .agg(*_measures())
         .withColumn("t", week_index("wk")))
    return g.withColumn("dose", dose_expr()) if with_dose else g


def customer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c, wk, n, k, t): the same measures with the customer as unit -- the number of
    units grows with the tables (no join needed: the unit is on the order)."""
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderstatus", "o_orderdate"])
    return (o.groupBy(F.col("o_custkey").alias("c"), week_start("o_orderdate").alias("wk"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).cast("bigint").alias("k"))
            .withColumn("t", week_index("wk")))


def order_panel_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, day, n, k, delta, mob, week): one row per unit-day that has orders."""
    return (_order_facts(spark, sf_dir)
            .groupBy(F.col("c_nationkey").cast("int").alias("u"), F.to_date("o_orderdate").alias("day"))
            .agg(*_measures())
            .withColumn("week", F.weekofyear("day")))


def shipment_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second source on the same keys: lines by supplier nation and ship week.
    (u, wk, n, k, mob, t) with n = lines, k = returned lines, mob = sum of line prices."""
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate"])
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    return (li.join(s, li.l_suppkey == s.s_suppkey)
            .groupBy(F.col("s_nationkey").cast("int").alias("u"), week_start("l_shipdate").alias("wk"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("bigint").alias("k"),
                 F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("mob"))
            .withColumn("t", week_index("wk")))


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, t, n, k, mob): lines, returned lines and line prices by supplier and ship month
    (months since 1992-01) -- units grow with the tables."""
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate"])
    month = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("int")
    return (li.groupBy(F.col("l_suppkey").cast("int").alias("u"), month.alias("t"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("bigint").alias("k"),
                 F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("mob")))


def unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, n_name, r_name): unit names and their region (the 'state' of a unit)."""
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("n_nationkey").cast("int").alias("u"), "n_name", "r_name"))
