"""Connected parts of the unit-time graph of a panel, per cohort.

Units and times are the nodes and the rows the edges: two effects of a two-way model can be
compared only where a path of rows leads from one to the other. A unit joins all its times to
its first one, so the graph on the times alone -- edges (first time of a unit, other time of it),
each once per cohort -- has the same parts, and it is bounded by the calendar, not by the units.

Parts are found on that small graph by taking the least label of the neighbours and then the
label of that label, until a round changes nothing: about the logarithm of the longest path.
All cohorts run together. Labels are written each round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def time_parts(rows: DataFrame, keys: Sequence[str], unit: str, t: str) -> DataFrame:
    """(keys, t, part): the least time that is connected with t through `rows`. A row with a
    null key, unit or time connects nothing."""
    keys = list(keys)
    own = rows.select(*keys, unit, t).filter(F.col(unit).isNotNull() & F.col(t).isNotNull())
    first = F.min(t).over(Window.partitionBy(*keys, unit))
    edges = materialize(own.withColumn("__a", first).select(*keys, "__a", F.col(t).alias("__b")).distinct(), "edges")
    # every time is the end of an edge, be it from itself
    labels = materialize(edges.groupBy(*keys, F.col("__b").alias("__t")).agg(F.min("__a").alias("part")), "parts")
    both = edges.filter("__a <> __b")
    both = both.unionByName(both.select(*keys, F.col("__b").alias("__a"), F.col("__a").alias("__b")))
    while True:
        seen = both.join(labels.withColumnRenamed("__t", "__a"), [*keys, "__a"]).groupBy(*keys, F.col("__b").alias("__t")) \
            .agg(F.min("part").alias("__seen"))
        low = labels.withColumnRenamed("part", "__old").join(seen, [*keys, "__t"], "left") \
            .withColumn("__low", F.least("__old", F.coalesce("__seen", "__old")))
        jump = labels.select(*keys, F.col("__t").alias("__low"), F.col("part").alias("__far"))
        moved = materialize(low.join(jump, [*keys, "__low"]).select(*keys, "__t", "__old", F.least("__low", "__far").alias("part")), "parts")
        labels = moved.drop("__old")
        if moved.filter("part <> __old").limit(1).count() == 0:
            return labels.withColumnRenamed("__t", t)
