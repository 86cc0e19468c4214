"""Reshape and panel-structure operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..spec import PanelSpec


# ------------------------------------------------------------------ P1 wide -> long

def wide_to_long(df: DataFrame, ids: Sequence[str], prefix: str, index: str, value: str,
                 index_type: str = "int") -> DataFrame:
    """Columns ``<prefix><number>`` become rows (ids..., index, value).

    Null values are kept (every id x column pair gives a row). The numeric suffix
    becomes the index column. Runs as a narrow Expand: no shuffle.
    """
    cols = [c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit()]
    if not cols:
        raise ValueError(f"no columns named {prefix}<number>")
    long = df.unpivot(list(ids), cols, "__col", value)
    return long.select(*ids, F.substring("__col", len(prefix) + 1, 1 << 30).cast(index_type).alias(index), value)


def long_to_wide(df: DataFrame, ids: Sequence[str], index: str, value: str, prefix: str,
                 index_values: Sequence[int]) -> DataFrame:
    """Inverse of P1 for an explicit, bounded list of index values (one column each)."""
    w = df.groupBy(*ids).pivot(index, list(index_values)).agg(F.first(value))
    return w.withColumnsRenamed({str(v): f"{prefix}{v}" for v in index_values})


# ------------------------------------------------------------------ P4 key checks

def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise if the keys are not unique (one distributed aggregate + a 1-row take)."""
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise ValueError(f"keys {list(keys)} are not unique, e.g. {bad[0].asDict()}")
    return df


# ------------------------------------------------------------------ P6 / P7

def select_present(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Keep the listed columns that exist, in the listed order."""
    have = set(df.columns)
    return df.select(*[c for c in names if c in have])


def recode(df: DataFrame, c: str, mapping: Mapping | DataFrame, out: str | None = None) -> DataFrame:
    """Replace values found in `mapping`; others are kept.

    A dict becomes a literal map lookup (no join, stays in codegen). A DataFrame
    (from, to) is joined on `from`; Spark broadcasts it when its size check allows.
    """
    out = out or c
    if isinstance(mapping, DataFrame):
        frm, to = mapping.columns[:2]
        m = mapping.select(F.col(frm).alias("__from"), F.col(to).alias("__to"))
        j = df.join(m, F.col(c) == F.col("__from"), "left")
        return j.withColumn(out, F.coalesce(F.col("__to"), F.col(c))).drop("__from", "__to")
    if not mapping:
        return df.withColumn(out, F.col(c))
    lut = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, F.coalesce(F.try_element_at(lut, F.col(c)), F.col(c)))


# ------------------------------------------------------------------ P15 outcomes

def melt_outcomes(df: DataFrame, ids: Sequence[str], outcomes: Sequence[str], scale: float = 1.0,
                  name: str = "outcome", value: str = "Y") -> DataFrame:
    """One row per (ids, outcome) with the chosen measure, times `scale`."""
    long = df.unpivot(list(ids), list(outcomes), name, value)
    if scale != 1.0:
        long = long.withColumn(value, F.col(value) * F.lit(float(scale)))
    return long


# ------------------------------------------------------------------ P16 dense ids

def dense_ids(keys_df: DataFrame, keys: Sequence[str], out: str = "id", within: Sequence[str] = ()) -> DataFrame:
    """Distinct key table with a dense 1-based id in key order.

    Keys are range-partitioned, numbered inside each range, and shifted by the
    counts of the lower ranges -- no step sees all keys in one task. With `within`, ids
    restart per group: the keys are numbered in (group, key) order and each group's
    first number is taken off, so a group of any size is no single task either.
    """
    d = keys_df.select(*within, *keys).distinct()
    if within:
        every = materialize(dense_ids(d, [*within, *keys], out), "ids")
        first = every.groupBy(*within).agg(F.min(out).alias("__first"))
        return every.join(first, list(within)).withColumn(out, (F.col(out) - F.col("__first") + 1).cast("int")).drop("__first")
    nparts = max(1, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    r = d.repartitionByRange(nparts, *keys).withColumn("__pid", F.spark_partition_id())
    # written once: both uses below must see the same sampled range bounds
    r = materialize(r.withColumn("__rn", F.row_number().over(Window.partitionBy("__pid").orderBy(*keys))), "ids")
    sizes = r.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    # one row per range: tiny, so the running total over it is cheap
    offs = sizes.withColumn("__off", F.coalesce(F.sum("__cnt").over(
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (r.join(F.broadcast(offs.select("__pid", "__off")), "__pid")
            .withColumn(out, (F.col("__off") + F.col("__rn")).cast("int"))
            .drop("__pid", "__rn", "__off"))


def dense_unit_id(df: DataFrame, keys: Sequence[str], out: str = "id", within: Sequence[str] = (),
                  zero_when: Column | None = None) -> DataFrame:
    """Attach a dense integer id of the key columns; rows matching `zero_when` get 0."""
    ids = dense_ids(df, keys, out, within)
    res = df.join(ids, [*within, *keys], "left")
    if zero_when is not None:
        res = res.withColumn(out, F.when(zero_when, F.lit(0)).otherwise(F.col(out)))
    return res


# ------------------------------------------------------------------ W10 / Y1 calendar

def _calendar(df: DataFrame, spec: PanelSpec, step: int = 1) -> DataFrame:
    """Units x [min time .. max time] of the whole panel. The two bounds are read first (one
    aggregate; `df` should be a written frame) and are literals of the plan, so no join is
    needed to attach them."""
    lo, hi = df.agg(F.min(spec.time), F.max(spec.time)).first()
    step_e = F.expr(f"INTERVAL {step} DAY") if dict(df.dtypes)[spec.time] == "date" else F.lit(step)
    units = df.select(*spec.unit).distinct()
    if lo is None:
        return units.select(*spec.unit, F.lit(None).cast(df.schema[spec.time].dataType).alias(spec.time)).limit(0)
    kind = df.schema[spec.time].dataType
    times = F.sequence(F.lit(lo).cast(kind), F.lit(hi).cast(kind), step_e)
    return units.select(*spec.unit, F.explode(times).alias(spec.time))


def calendar_grid(df: DataFrame, spec: PanelSpec, times: DataFrame | None = None, step: int = 1) -> DataFrame:
    """Every unit x every time. `times` is a one-column calendar table (bounded by the
    calendar length); by default the span of the panel's own times."""
    if times is None:
        return _calendar(df, spec, step)
    cal = times.select(F.collect_set(F.col(times.columns[0])).alias("__ts"))
    units = df.select(*spec.unit).distinct()
    return units.join(F.broadcast(cal)).select(*spec.unit, F.explode("__ts").alias(spec.time))


def gap_runs(df: DataFrame, spec: PanelSpec, step: int = 1) -> DataFrame:
    """The absent times of every unit as runs (unit, gap_start, gap_end, gap_length) inside the
    panel's span, found between neighbouring rows: one window over the rows that are there, and one
    row for each gap, however long. The span is read first (one aggregate; `df` should be a written
    frame). A unit whose times are all null is one gap; rows without a time count for nothing else."""
    lo, hi = df.agg(F.min(spec.time), F.max(spec.time)).first()
    kind = df.schema[spec.time].dataType
    dated = kind.simpleString() == "date"
    lo, hi, t = F.lit(lo).cast(kind), F.lit(hi).cast(kind), F.col(spec.time)
    w = spec.window()
    plus = lambda c, n: (F.date_add(c, n) if dated else c + F.lit(n)).cast(kind)
    run = lambda a, b: F.when(a <= b, F.struct(a.alias("gap_start"), b.alias("gap_end")))
    before = F.coalesce(plus(F.lag(t).over(w), step), lo)
    last = t.isNotNull() & F.lead(t).over(w).isNull()
    never = F.max(t).over(spec.unit_window()).isNull() & (F.row_number().over(w) == 1)
    runs = F.array(F.when(t.isNotNull(), run(before, plus(t, -step))), F.when(last, run(plus(t, step), hi)), F.when(never, run(lo, hi)))
    out = df.select(*spec.unit, F.array_compact(runs).alias("__runs"))
    out = out.select(*spec.unit, F.explode("__runs").alias("__run")).select(*spec.unit, "__run.*")
    size = (F.datediff("gap_end", "gap_start") if dated else F.col("gap_end") - F.col("gap_start"))
    return out.withColumn("gap_length", (F.floor(size / step) + 1).cast("long"))


def _missing(df: DataFrame, spec: PanelSpec, step: int) -> DataFrame:
    """The unit-time rows inside the gaps: rows only for what is missing."""
    step_e = F.expr(f"INTERVAL {step} DAY") if df.schema[spec.time].dataType.simpleString() == "date" else F.lit(step)
    return gap_runs(df, spec, step).select(*spec.unit, F.explode(F.sequence("gap_start", "gap_end", step_e)).alias(spec.time))


def complete_panel(df: DataFrame, spec: PanelSpec, times: DataFrame | None = None,
                   fill: Mapping[str, object] | None = None, step: int = 1,
                   flag: str | None = None) -> DataFrame:
    """Add the missing unit-time rows; listed columns of added rows get the fill
    value, other columns stay null. `flag` names an optional 0/1 column marking added rows. Without
    a calendar of its own the panel's span is completed: the rows that are there are kept (but those
    without a time) and the gaps' rows added, no unit x time grid is joined."""
    fill, order = dict(fill or {}), [*spec.keys, *[c for c in df.columns if c not in spec.keys]]
    if times is None and step == 1:
        added = _missing(df, spec, step).withColumns({c: F.lit(v).cast(dict(df.dtypes)[c]) for c, v in fill.items()})
        here = df.filter(F.col(spec.time).isNotNull())
        if flag:
            here, added = here.withColumn(flag, F.lit(0)), added.withColumn(flag, F.lit(1))
        return here.unionByName(added, allowMissingColumns=True).select(*order, *([flag] if flag else []))
    grid = calendar_grid(df, spec, times, step)
    src = df.withColumn("__have", F.lit(1))
    out = grid.join(src, spec.keys, "left")
    for c, v in fill.items():
        out = out.withColumn(c, F.when(F.col("__have").isNull(), F.lit(v).cast(dict(df.dtypes)[c]))
                             .otherwise(F.col(c)))
    if flag:
        out = out.withColumn(flag, F.when(F.col("__have").isNull(), 1).otherwise(0))
    return out.drop("__have")


def insert_times(df: DataFrame, spec: PanelSpec, times: Sequence) -> DataFrame:
    """W10 (listed times): every unit gets a row for each listed time it lacks (other
    columns null); existing rows are untouched and other absent times stay absent."""
    lits = F.array(*[F.lit(x) for x in times]).cast(f"array<{dict(df.dtypes)[spec.time]}>")
    add = (df.select(*spec.unit).distinct()
           .select(*spec.unit, F.explode(lits).alias(spec.time))
           .join(df.select(*spec.keys), spec.keys, "left_anti"))
    return df.unionByName(add, allowMissingColumns=True)


def panel_gaps(df: DataFrame, spec: PanelSpec, times: DataFrame | None = None, step: int = 1) -> DataFrame:
    """Unit-time rows absent from the panel (empty = balanced)."""
    if times is None and step == 1:
        return _missing(df, spec, step)
    return calendar_grid(df, spec, times, step).join(df.select(*spec.keys), spec.keys, "left_anti")
