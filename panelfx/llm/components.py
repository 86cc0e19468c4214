"""Connected components of an edge table, by minimum label with pointer doubling.

Each round sends every node the smallest label among its neighbours and then follows the
label's own label, so labels settle in about log2 of a component's diameter rounds. Rounds
are cut by written stages; the loop ends when a round changes nothing. A node with very many
edges is a partial aggregate per task, never a group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable, for every node that has an edge."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = common.stage(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = common.stage(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
                          .select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("seen")), "v") \
            .groupBy(F.col("u").alias("node")).agg(F.min("seen").alias("seen"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = common.stage(step.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        changed = moved.filter("label <> old").count()
        labels = moved.drop("old")
        if changed == 0:
            return labels
