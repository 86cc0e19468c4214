"""Series operators on units of any length (W1-W9): time segments instead of whole units.

A window over a unit is one task's work however long the unit is. Here a unit's rows are numbered
(range-partitioned by unit and time, so a unit with a third of all rows is many tasks) and cut
into segments of `length` rows. A segment also gets the last `back` rows before it and the first
`ahead` rows after it, its halo; the windows of ``series`` then run per segment, and the halo's rows
are dropped. What reaches back without bound is carried: running totals and last good values
are taken per segment first, then along the segments, a table with one row for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..spec import PanelSpec

LENGTH = 100_000
_POS, _SEG, _OWN = "__pos", "__seg", "__own"


def numbered(df: DataFrame, spec: PanelSpec, length: int = LENGTH) -> DataFrame:
    """`df` with each row's number within its unit (from 0) and its segment. Written. Rows of one unit
    and time follow each other in no set order."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.asc_nulls_first(c) for c in spec.keys]
    ranged = df.repartitionByRange(parts, *keys).withColumn("__pid", F.spark_partition_id())
    inside = Window.partitionBy("__pid", *spec.unit).orderBy(F.asc_nulls_first(spec.time))
    # written once: range bounds are sampled, and both uses below must see the same ones
    ranged = materialize(ranged.withColumn("__rn", F.row_number().over(inside)), "ranges")
    sizes = ranged.groupBy("__pid", *spec.unit).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*spec.unit).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # only units that continue from an earlier range have an offset: at most one for each range
    offset = sizes.withColumn("__off", F.sum("__n").over(before)).filter(F.col("__off") > 0) \
        .select(*[F.col(c).alias(f"__o_{c}") for c in ["__pid", *spec.unit]], "__off")
    same = [ranged[c].eqNullSafe(offset[f"__o_{c}"]) for c in ["__pid", *spec.unit]]
    out = ranged.join(F.broadcast(offset) if offset.count() <= 10 * parts else offset, same, "left")
    pos = F.col("__rn") - 1 + F.coalesce("__off", F.lit(0))
    out = out.withColumn(_POS, pos.cast("long")).withColumn(_SEG, F.floor(F.col(_POS) / length).cast("long"))
    return materialize(out.select(*df.columns, _POS, _SEG), "numbered")


def segment_spec(spec: PanelSpec) -> PanelSpec:
    """The panel whose units are the segments, in row order."""
    return PanelSpec((*spec.unit, _SEG), _POS)


def over_segments(rows: DataFrame, spec: PanelSpec, build: Callable[[PanelSpec], dict[str, Column]], back: int = 0, ahead: int = 0,
                  length: int = LENGTH) -> DataFrame:
    """`rows` (of `numbered`, same `length`) with the columns `build` gives for the segments' spec:
    expressions of ``series`` that look at most `back` rows behind and `ahead` rows ahead."""
    if max(back, ahead) > length:
        raise ValueError("a halo must not be longer than a segment")
    at = F.pmod(F.col(_POS), F.lit(length))
    copies = F.array_compact(F.array(F.lit(0), F.when(at >= length - back, F.lit(1)) if back else F.lit(None),
                                     F.when((at < ahead) & (F.col(_SEG) > 0), F.lit(-1)) if ahead else F.lit(None)))
    halo = rows.withColumn("__to", F.explode(copies)).withColumn(_OWN, F.col("__to") == 0) \
        .withColumn(_SEG, F.col(_SEG) + F.col("__to")).drop("__to")
    return halo.withColumns(build(segment_spec(spec))).filter(_OWN).drop(_OWN)


def _carried(rows: DataFrame, spec: PanelSpec, ends: list[Column], carry: dict[str, Column]) -> DataFrame:
    """`rows` with columns taken along the segments: `ends` are aggregates of a segment, `carry`
    windows over the segments before it."""
    per = rows.groupBy(*spec.unit, _SEG).agg(*ends).withColumns(carry).select(*spec.unit, _SEG, *carry)
    per = per.select(*[F.col(c).alias(f"__c_{c}") for c in [*spec.unit, _SEG]], *carry)
    same = [rows[c].eqNullSafe(per[f"__c_{c}"]) for c in [*spec.unit, _SEG]]
    return rows.join(per, same, "left").drop(*[f"__c_{c}" for c in [*spec.unit, _SEG]])


def _before(spec: PanelSpec):
    return Window.partitionBy(*spec.unit).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)


def running_total(rows: DataFrame, spec: PanelSpec, c: str, out: str) -> DataFrame:
    """The sum of `c` over the unit's rows up to each (nulls skipped; null before the first value)."""
    r = _carried(rows, spec, [F.sum(c).alias("__s")], {"__prefix": F.sum("__s").over(_before(spec))})
    own = F.sum(c).over(segment_spec(spec).frame(Window.unboundedPreceding, 0))
    total = F.when(own.isNull(), F.col("__prefix")).otherwise(own + F.coalesce("__prefix", F.lit(0)))
    return r.withColumn(out, total).drop("__prefix")


def repair_last_good(rows: DataFrame, spec: PanelSpec, c: str, out: str) -> DataFrame:
    """A negative value becomes the unit's last earlier non-negative one, null if there is none."""
    x = F.col(c)
    good = F.when(x >= 0, x)
    last = F.max_by(good, F.when(good.isNotNull(), F.col(_POS))).alias("__g")
    r = _carried(rows, spec, [last], {"__last": F.last("__g", ignorenulls=True).over(_before(spec))})
    inside = F.last(good, ignorenulls=True).over(segment_spec(spec).frame(Window.unboundedPreceding, -1))
    return r.withColumn(out, F.when(x < 0, F.coalesce(inside, F.col("__last"))).otherwise(x)).drop("__last")
