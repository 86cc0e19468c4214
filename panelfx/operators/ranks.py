"""Exact ranks of many values among many points without pairing them.

Points and questions are sorted together by (key, value) in ranges; the points before a question
are those before it in its range, by a running sum, plus those of its key in the ranges before,
a table with at most one row for each range and key that continues there. Cost: one sort. Equal
points are one row with a count, so a value that a third of all points share is one row too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def rank_counts(points: DataFrame, questions: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """`questions` with the number of points of the same key below its value (n_below), up to it
    (n_upto) and in all (n_points). Null values are no points; a null question gets null counts
    but n_points. Keys compare as values, null being one."""
    keys = list(keys)
    kinds = {f.name: f.dataType for f in points.schema.fields}
    weighed = points.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__w"))
    asked = questions.filter(F.col(value).isNotNull()).select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], F.col(value).cast(kinds[value]).alias(value)).distinct()
    # at one value: the question below, the points, the question above
    rows = weighed.withColumn("__side", F.lit(1)).unionByName(
        asked.withColumns({"__w": F.lit(0).cast("long"), "__side": F.explode(F.array(F.lit(0), F.lit(2)))}))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [*[F.asc_nulls_first(k) for k in keys], value, "__side"]
    ranged = rows.repartitionByRange(parts, *order).withColumn("__pid", F.spark_partition_id())
    run = Window.partitionBy("__pid", *keys).orderBy(value, "__side").rowsBetween(Window.unboundedPreceding, 0)
    # written once: range bounds are sampled, and both uses below must see the same ones
    ranged = materialize(ranged.withColumn("__run", F.sum("__w").over(run)), "ranks")
    per = ranged.groupBy("__pid", *keys).agg(F.sum("__w").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offset = per.withColumn("__off", F.sum("__sum").over(before)).filter(F.col("__off") > 0)
    same = lambda a, b, cols: [a[c].eqNullSafe(b[f"__o_{c}"]) for c in cols]
    o = offset.select(*[F.col(c).alias(f"__o_{c}") for c in ["__pid", *keys]], "__off")
    placed = ranged.filter("__side <> 1")
    placed = placed.join(F.broadcast(o) if o.count() <= 10 * parts else o, same(placed, o, ["__pid", *keys]), "left") \
        .groupBy(*keys, value).agg(*[F.max(F.when(F.col("__side") == side, F.col("__run") + F.coalesce("__off", F.lit(0)))).alias(n)
                                     for side, n in ((0, "n_below"), (2, "n_upto"))])
    totals = weighed.groupBy(*keys).agg(F.sum("__w").alias("n_points"))
    q, p, n = questions, placed, totals
    p = p.select(*[F.col(c).alias(f"__o_{c}") for c in [*keys, value]], "n_below", "n_upto")
    q = q.join(p, same(q, p, [*keys, value]), "left").drop(*[f"__o_{c}" for c in [*keys, value]])
    n = n.select(*[F.col(c).alias(f"__o_{c}") for c in keys], "n_points")
    return q.join(n, same(q, n, keys), "left").drop(*[f"__o_{c}" for c in keys]) \
        .withColumn("n_points", F.coalesce("n_points", F.lit(0).cast("long")))
