"""Synthetic-control weights by column generation (Y3/Y4 with pools of any size).

The weights of a fit lie on few donors, at most one more than there are predictors, so the
problem is solved on a few columns and the donors are only priced:

* master   per fit, the simplex least squares of ``synth`` over the columns generated so far; it
           gives weights w and the residual r = X w - b. Columns without weight are dropped.
* pricing  over all donors, those with the smallest r.(x_j - b); with the smallest of them the
           duality gap (r.r - min_j r.(x_j - b)) / max_j |x_j - b|^2 of the *whole* problem, the same
           proof of optimality ``synth_weights`` gives. The best donors become columns.

A fit is finished when its gap has reached rounding (a thousandth of `tol`), or when pricing
finds no column it does not have and the gap is within `tol`; otherwise, and when rounds run
out, the job raises. No donor is left out: each is priced in every round.

Pools. Where a pool's cohorts have the same donors (`synth_weights_pools`), these are stored and priced once,
unscaled; a cohort's scale multiplies its residual instead, and the few columns its fit holds.

Distribution. Donors are packed once into blocks of at most `BLOCK_BYTES` (one row each, written)
and the residuals of the open fits into blocks likewise; a (donor block, fit block) pair is
one row and one matrix product, and yields `columns` candidates for a fit. No task holds a cohort's
donors, and what a fit holds is bounded by the predictors. Fits and columns are written each round.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .cohort import COHORT_KEYS
from .pools import POOL
from .synth import simplex_least_squares, weight_schema

try:  # ship this module's code with the task, so workers need no installed copy
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # older pickler: rely on the package being on the executors' path
    pass

BLOCK_BYTES = 8 << 20


def unit_vectors(pred: DataFrame, unit: str = "u", scaled: bool = True, on_gap: str = "raise") -> DataFrame:
    """(keys, unit, treated, x): a unit's predictors as one array in (predictor, time) order. Units
    whose predictors are not those of the treated unit are refused, or dropped with on_gap="drop"."""
    x = F.col("x_scaled" if scaled else "x")
    packed = F.array_sort(F.collect_list(F.struct("var", "t", x.alias("v"))))
    vec = pred.groupBy(*COHORT_KEYS, F.col(unit).alias("unit"), "treated").agg(packed.alias("__p"))
    vec = vec.select(*COHORT_KEYS, "unit", "treated", F.col("__p.v").alias("x"),
                     F.xxhash64(F.transform("__p", lambda s: F.struct(s["var"], s["t"], s["v"].isNull()))).alias("sig"))
    vec = materialize(vec, "vectors")
    ref = vec.filter("treated = 1").select(*COHORT_KEYS, F.col("sig").alias("__ref"))
    vec = vec.join(ref, COHORT_KEYS)
    if on_gap == "raise" and vec.filter("sig <> __ref").limit(1).count():
        raise ValueError("units of a cohort have different predictor sets (times or values are missing); "
                         "drop such units before fitting (CohortRules does by default), or pass on_gap='drop'")
    return vec.filter("sig = __ref").drop("sig", "__ref")


def _matrix(cells, k: int) -> np.ndarray:
    return np.frombuffer(cells, np.float64).reshape(-1, k)


def _packed(rows: DataFrame, keys: list[str], name: str, value: str, kind: T.DataType) -> DataFrame:
    """(keys, names array, k, cells binary): each group's vectors as one row, by name."""
    schema = T.StructType([*[rows.schema[c] for c in keys], T.StructField("names", T.ArrayType(kind)),
                           T.StructField("k", T.IntegerType()), T.StructField("cells", T.BinaryType())])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by(name)
        x = table[value].combine_chunks()
        flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.table([*(table[c].slice(0, 1) for c in keys), pa.array([table[name].to_pylist()], pa.list_(table.schema.field(name).type)),
                         pa.array([len(flat) // len(table)], pa.int32()), pa.array([flat.tobytes()], pa.binary())],
                        names=[f.name for f in schema.fields])

    return rows.groupBy(*keys).applyInArrow(pack, schema)


def _price(donors: DataFrame, fits: DataFrame, keys: list[str], kind: T.DataType, columns: int, first: bool) -> DataFrame:
    """(keys, fit_unit, donor, score, norm): for each open fit the `columns` donors of each block
    with the least score, r.x_j or at first |x_j - b|^2, and the largest |x_j - b|^2 there; x_j is the
    donor's vector times the fit's own scale, which is moved to the fit's side of the products."""
    pairs = donors.join(fits, [*keys, "block"])
    n = len(keys)
    schema = T.StructType([*[donors.schema[c] for c in keys], T.StructField("fit_unit", kind), T.StructField("donor", kind),
                           T.StructField("score", T.DoubleType()), T.StructField("norm", T.DoubleType())])
    names = [f.name for f in schema.fields]

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1)
                units, k, cells, fit_units, goal, residual, by = (row.column(i)[0] for i in range(n, n + 7))
                k = k.as_py()
                if not k:
                    continue
                X, B, S = _matrix(cells.as_py(), k), _matrix(goal.as_py(), k), _matrix(by.as_py(), k)
                norm = (S ** 2) @ (X ** 2).T + (B ** 2).sum(axis=1)[:, None] - 2 * (B * S) @ X.T
                score = norm if first else (_matrix(residual.as_py(), k) * S) @ X.T
                own = {u: i for i, u in enumerate(units.as_py())}
                out = [], [], [], []
                for i, f in enumerate(fit_units.as_py()):
                    s = score[i].copy()
                    if f in own:                          # a donor is none of its own placebo
                        s[own[f]] = np.inf
                    best = np.argsort(s, kind="stable")[:columns]
                    best = best[np.isfinite(s[best])]
                    high = norm[i].max() if f not in own else np.delete(norm[i], own[f]).max(initial=0.0)
                    out[0].extend([i] * len(best))
                    out[1].extend(best.tolist())
                    out[2].extend(s[best].tolist())
                    out[3].extend([float(high)] * len(best))
                if out[0]:
                    key = [row.column(i).take(pa.array([0] * len(out[0]))) for i in range(n)]
                    yield pa.RecordBatch.from_arrays([*key, fit_units.values.take(pa.array(out[0])), units.values.take(pa.array(out[1])),
                                                      pa.array(out[2]), pa.array(out[3])], names=names)

    return pairs.select(*keys, "names", "k", "cells", "fits", "goal", "residual", "by").mapInArrow(run, schema)


def _master(state: DataFrame, tol: float) -> DataFrame:
    """`state` with each open fit's problem solved over its columns: weights, residual, its loss and
    r.b; columns without weight dropped."""
    names = state.columns

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["open"]:
                    cols, goal = row["cols"], np.array(row["b"])
                    A = np.array([c["x"] for c in cols], np.float64).reshape(len(cols), len(goal)).T
                    w, _ = simplex_least_squares(A, goal, tol)
                    r = A @ w - goal
                    row["cols"] = [{**c, "w": float(v)} for c, v in zip(cols, w) if v > 0]
                    row["r"], row["rr"], row["rb"] = r.tolist(), float(r @ r), float(r @ goal)
                out.append(row)
            if out:
                yield from pa.Table.from_pylist(out, schema=b.schema.remove_metadata()).select(names).to_batches()

    return state.mapInArrow(run, state.schema)


def synth_weights_columns(pred: DataFrame, unit: str = "u", placebo: bool = True, scaled: bool = True, on_gap: str = "raise",
                          tol: float = 1e-8, columns: int = 16, max_rounds: int = 300, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(cohort keys, fit_unit, donor, weight, fit_rmse, gap) with weight > 0, all predictors
    weighing alike; as ``synth.synth_weights``, without a task that holds a cohort's donors."""
    types = {f.name: f.dataType for f in pred.schema.fields}
    kind = types[unit]
    vec = materialize(unit_vectors(pred, unit, scaled, on_gap), "vectors")
    fits = vec.filter("treated = 1" if not placebo else "true").select(
        *COHORT_KEYS, F.col("unit").alias("fit_unit"), F.col("x").alias("b"), F.transform("x", lambda v: F.lit(1.0)).alias("by"))
    out = _generate(vec.filter("treated = 0").drop("treated"), fits, COHORT_KEYS, kind, tol, columns, max_rounds, block_bytes)
    return out.select(*[f.name for f in weight_schema(types, kind).fields])


def synth_weights_pools(donors: DataFrame, fits: DataFrame, tol: float = 1e-8, columns: int = 16, max_rounds: int = 300,
                        block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Y3 on the vectors of ``synth.pool_vectors``: what `synth_weights_columns` gives with placebo=False
    on the expanded cohorts, with the donors stored and priced once for a pool's cohorts."""
    kind = donors.schema["unit"].dataType
    out = _generate(donors, fits, POOL, kind, tol, columns, max_rounds, block_bytes).withColumn("treated_unit", F.col("fit_unit"))
    types = {f.name: f.dataType for f in out.schema.fields}
    return out.select(*[f.name for f in weight_schema(types, kind).fields])


def _generate(donors: DataFrame, fits: DataFrame, keys: list[str], kind: T.DataType, tol: float, columns: int, max_rounds: int,
              block_bytes: int) -> DataFrame:
    """The rounds over `donors` (keys, unit, x) and `fits` (keys, fit_unit, b, by): a fit's columns are its
    donors' vectors times `by`."""
    vec = donors
    sizes = vec.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max(F.size("x")).alias("__k"))
    per = F.greatest(F.lit(1), F.floor(F.lit(block_bytes) / (F.greatest(F.col("__k"), F.lit(1)) * 8)))
    sizes = materialize(sizes.select(*keys, F.ceil(F.col("__n") / per).cast("int").alias("__blocks"), per.alias("__per")), "sizes")
    nparts = max(vec.sparkSession.sparkContext.defaultParallelism, int(vec.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = vec.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("unit"), F.col("__blocks")).cast("int"))
    donors = materialize(_packed(dealt.select(*keys, "block", "unit", "x"), [*keys, "block"], "unit", "x", kind)
                         .repartition(nparts, *keys, "block"), "donors")

    col = T.ArrayType(T.StructType([T.StructField("donor", kind), T.StructField("x", T.ArrayType(T.DoubleType())),
                                    T.StructField("w", T.DoubleType())]))
    state = fits.select(*keys, "fit_unit", "b", "by", F.array().cast(col).alias("cols"),
                        F.col("b").alias("r"), F.lit(0.0).alias("rr"), F.lit(0.0).alias("rb"), F.lit(0.0).alias("scale"),
                        F.lit(float("inf")).alias("gap"), F.lit(True).alias("open"))
    state = materialize(state.join(sizes.select(*keys), keys, "left_semi"), "fits")
    fit = [*keys, "fit_unit"]
    for round_ in range(max_rounds):
        # the residuals of the open fits, in blocks, against every block of donors
        open_ = state.filter("open").join(sizes, keys)
        share = F.floor(F.row_number().over(Window.partitionBy(*keys, F.pmod(F.xxhash64("fit_unit"), F.lit(64))).orderBy("fit_unit")) / F.col("__per"))
        open_ = open_.withColumn("part", F.concat_ws("/", F.pmod(F.xxhash64("fit_unit"), F.lit(64)), share))
        both = open_.select(*keys, "part", "fit_unit", "__blocks", F.concat("b", "r", "by").alias("br"))
        packed = _packed(both.select(*keys, "part", "fit_unit", "br"), [*keys, "part"], "fit_unit", "br", kind)
        packed = packed.join(sizes.select(*keys, "__blocks"), keys)
        split = _split(packed, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        priced = _price(donors, split, keys, kind, columns, first=round_ == 0)
        rank = F.row_number().over(Window.partitionBy(*fit).orderBy("score", "donor"))
        best = materialize(priced.withColumn("n", rank), "priced")
        found = best.groupBy(*fit).agg(F.min("score").alias("__least"), F.max("norm").alias("__norm"))
        chosen = best.filter(F.col("n") <= columns).join(
            vec.select(*keys, F.col("unit").alias("donor"), "x"), [*keys, "donor"])
        chosen = chosen.groupBy(*fit).agg(F.sort_array(F.collect_list(F.struct("donor", "x", F.lit(0.0).alias("w")))).alias("__new"))
        s = state.join(found, fit, "left").join(chosen, fit, "left")
        scaled = F.transform("__new", lambda c: F.struct(c["donor"], F.zip_with(c["x"], "by", lambda v, k: v * k).alias("x"), c["w"]))
        have = F.transform("cols", lambda c: c["donor"])
        fresh = F.filter(F.coalesce(scaled.cast(col), F.array().cast(col)), lambda c: ~F.array_contains(have, c["donor"]))
        s = s.withColumn("fresh", fresh)
        if round_ == 0:
            s = s.withColumns({"scale": F.greatest(F.coalesce("__norm", F.lit(0.0)), F.lit(1e-300)), "open": F.col("open") & F.col("__least").isNotNull()})
        else:
            gap = F.greatest(F.lit(0.0), (F.col("rr") - (F.col("__least") - F.col("rb"))) / F.col("scale"))
            s = s.withColumn("gap", F.when(F.col("open"), gap).otherwise(F.col("gap")))
            s = s.withColumn("open", F.col("open") & (F.col("gap") > tol * 1e-3) & (F.size("fresh") > 0))
        s = s.withColumn("cols", F.when(F.col("open"), F.concat("cols", "fresh")).otherwise(F.col("cols"))).select(*state.columns)
        state = materialize(_master(s.repartition(nparts), tol * 1e-2), "fits")
        if state.filter("open").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"column generation has not ended after {max_rounds} rounds")
    worst = state.filter(F.size("cols") > 0).agg(F.max("gap")).first()[0]
    if worst is not None and worst > tol:
        raise ValueError(f"no optimum within {tol}: the duality gap stays at {worst:.3g}")
    out = state.select(*fit, F.explode("cols").alias("c"), F.sqrt(F.col("rr") / F.greatest(F.size(F.filter("by", lambda v: v > 0)), F.lit(1))).alias("fit_rmse"), "gap")
    return out.select(*fit, F.col("c.donor").alias("donor"), F.col("c.w").alias("weight"), "fit_rmse", "gap")


def _split(packed: DataFrame, keys: list[str]) -> DataFrame:
    """The packed (b, r, by) as the columns `goal`, `residual` and `by`."""
    keep = [*keys, "names", "__blocks"]
    schema = T.StructType([*[packed.schema[c] for c in keys], T.StructField("fits", packed.schema["names"].dataType),
                           T.StructField("__blocks", T.IntegerType()), T.StructField("goal", T.BinaryType()), T.StructField("residual", T.BinaryType()),
                           T.StructField("by", T.BinaryType())])

    def run(batches):
        for b in batches:
            cells = [np.frombuffer(c, np.float64).reshape(-1, k) for c, k in zip(b.column("cells").to_pylist(), b.column("k").to_pylist())]
            halves = [np.split(c, 3, axis=1) for c in cells]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array([np.ascontiguousarray(h[i]).tobytes() for h in halves], pa.binary())
                                                                            for i in (0, 1, 2))], names=[f.name for f in schema.fields])

    return packed.select(*keep, "k", "cells").mapInArrow(run, schema)
