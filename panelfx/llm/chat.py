"""Tool-call linking (operator 1).

Calls and results are joined by (conversation, call id), ordered so that a call follows
the calls it needs, validated against argument schemas, and written as canonical JSON, one
line per call (RFC 8785: sorted keys, no white space, shortest numbers).

Ordering. A call's place is (layer, position, call id). A dependency that points to an
earlier position needs nothing more; only dependencies that point forward raise a layer:
a call's layer is the largest number of forward-pointing dependencies on a way to it. Only
conversations with such dependencies are iterated over, in rounds that settle every call
whose needs are settled; there are as many rounds as the longest chain of needs has calls.
A call on a cycle, or behind one, never settles: it has `cyclic` set, and its layer is one
over the conversation's number of forward dependencies, after all others.

Scale: first calls and first results are partial aggregates of their ids, then joined one
to one, so an id with a third of all rows is one row; conversations are never collected,
so one conversation may hold any share of the rows.

Defined results. Repeated ids: the first by position (then by content) counts, n_calls and
n_results tell how many there were. Result without call: status orphan. Call without
result: unanswered. Null call ids link to nothing: every such row stands alone (status
no_id). Arguments that are null, empty, or no JSON: invalid, written as null. A needed
call that does not exist: an error of the call. Very long contents are parsed and written whole,
one row at a time. Only the named columns are read, so extra ones cannot clash. Empty
tables: empty result.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# ------------------------------------------------------------------ canonical JSON

def canonical(value) -> str:
    """Canonical JSON of a parsed value; integers are written in full."""
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"


def _number(x: float) -> str:
    """A double as the shortest digits that give it back, in the notation of RFC 8785."""
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, exp = f"{x!r}".partition("e")
    if not exp:
        if abs(x) >= 1e-6:
            return digits
        digits, _, exp = f"{x:e}".partition("e")
    if -7 < int(exp) < 0:
        return f"{x:.{len(digits.replace('.', '').replace('-', '')) - 1 - int(exp)}f}"
    return f"{digits}e{int(exp):+d}"


def parse(text: str | None):
    """The value of a JSON text; raises ValueError for anything that is none."""
    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("repeated key")
        return out

    def no(name):
        raise ValueError(f"{name} is no JSON")

    return json.loads(text or "", object_pairs_hook=unique, parse_constant=no)


# ------------------------------------------------------------------ schemas

# The JSON types a schema can name, as Python types.
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a schema: type, enum, required, properties,
    additionalProperties, items, length, range and pattern rules."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, KINDS[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
        return [f"{at}: not {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, str):
        out += _range(len(value), schema, "Length", at)
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    elif isinstance(value, list):
        out += _range(len(value), schema, "Items", at)
        for i, v in enumerate(value):
            out += violations(v, schema.get("items", {}), f"{at}[{i}]")
    elif isinstance(value, dict):
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        known = schema.get("properties", {})
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf):
            out.append(f"{at}: minimum")
        if value > schema.get("maximum", math.inf):
            out.append(f"{at}: maximum")
    return out


def _range(n: int, schema: dict, what: str, at: str) -> list[str]:
    return [f"{at}: {k}{what}" for k, bad in (("min", n < schema.get(f"min{what}", 0)), ("max", n > schema.get(f"max{what}", n))) if bad]


# ------------------------------------------------------------------ linking and ordering

def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (conv, pos, call_id, name, arguments, needs) joined to results (conv, pos,
    call_id, content): conv, call_id, pos, name, arguments, needs, result_pos, content,
    n_calls, n_results, status."""
    first_call = calls.filter("call_id IS NOT NULL").groupBy("conv", "call_id").agg(
        F.min(F.struct("pos", "name", "arguments", "needs")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    first_result = results.filter("call_id IS NOT NULL").groupBy(F.col("conv").alias("r_conv"), F.col("call_id").alias("r_id")).agg(
        F.min(F.struct("pos", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    out = first_call.join(first_result, F.col("conv").eqNullSafe(F.col("r_conv")) & (F.col("call_id") == F.col("r_id")), "full")
    is_call = F.col("call_id").isNotNull()
    out = out.select(
        F.when(is_call, F.col("conv")).otherwise(F.col("r_conv")).alias("conv"), F.coalesce("call_id", "r_id").alias("call_id"),
        "c.pos", "c.name", "c.arguments", "c.needs", F.col("r.pos").alias("result_pos"), F.col("r.content").alias("content"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(is_call & F.col("r_id").isNotNull(), "linked").when(is_call, "unanswered").otherwise("orphan").alias("status"))
    none = F.lit(None)
    alone = calls.filter("call_id IS NULL").select(
        "conv", "call_id", "pos", "name", "arguments", "needs", none.cast("long").alias("result_pos"), none.cast("string").alias("content"),
        F.lit(1).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_results"), F.lit("no_id").alias("status"))
    alone_r = results.filter("call_id IS NULL").select(
        "conv", "call_id", none.cast("long").alias("pos"), none.cast("string").alias("name"), none.cast("string").alias("arguments"),
        none.cast("array<string>").alias("needs"), F.col("pos").alias("result_pos"), "content",
        F.lit(0).cast("long").alias("n_calls"), F.lit(1).cast("long").alias("n_results"), F.lit("no_id").alias("status"))
    return out.unionByName(alone).unionByName(alone_r)


def order(linked: DataFrame) -> DataFrame:
    """`linked` (a written frame) plus layer, cyclic and n_missing (needed calls that do
    not exist)."""
    nodes = linked.filter("n_calls > 0 AND call_id IS NOT NULL").select("conv", "call_id", "pos", "needs")
    edges = nodes.select("conv", F.col("call_id").alias("child"), F.col("pos").alias("child_pos"),
                         F.explode(F.array_distinct("needs")).alias("parent"))
    parents = nodes.select(F.col("conv").alias("p_conv"), F.col("call_id").alias("p_id"), F.col("pos").alias("p_pos"))
    edges = edges.join(parents, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("parent") == F.col("p_id")), "left")
    missing = edges.filter("p_id IS NULL").groupBy(F.col("conv").alias("m_conv"), F.col("child").alias("m_id")).agg(
        F.count(F.lit(1)).alias("n_missing"))
    later = F.struct("p_pos", "parent") >= F.struct(F.col("child_pos").alias("p_pos"), F.col("child").alias("parent"))
    edges = common.stage(edges.filter("p_id IS NOT NULL").select("conv", "child", "parent", later.cast("int").alias("forward")), "edges")
    out = linked.join(missing, F.col("conv").eqNullSafe(F.col("m_conv")) & (F.col("call_id") == F.col("m_id")), "left") \
        .withColumn("n_missing", F.coalesce("n_missing", F.lit(0))).drop("m_conv", "m_id")
    raised = edges.filter("forward = 1").groupBy(F.col("conv").alias("b_conv")).agg(F.count(F.lit(1)).alias("bound"))
    raised = common.stage(raised, "forward")
    if raised.limit(1).count() == 0:
        return out.withColumns({"layer": F.lit(0).cast("long"), "cyclic": F.lit(False)})

    # a call is settled once all it needs are; what never settles is on a cycle or behind one
    here = edges.join(raised, F.col("conv").eqNullSafe(F.col("b_conv")))
    here = common.stage(here.select("conv", "child", "parent", "forward"), "affected")
    open_needs = here.groupBy("conv", F.col("child").alias("id")).agg(F.count(F.lit(1)).alias("open"))
    ids = here.select("conv", F.col("child").alias("id"), F.lit(0).cast("long").alias("open")).union(
        here.select("conv", F.col("parent").alias("id"), F.lit(0).cast("long").alias("open"))).union(open_needs.select("conv", "id", "open"))
    state = common.stage(ids.groupBy("conv", "id").agg(F.max("open").alias("open"))
                         .withColumns({"layer": F.lit(0).cast("long"), "fresh": F.col("open") == 0}), "layer")
    while state.filter("fresh").limit(1).count():
        new = state.filter("fresh").select(F.col("conv").alias("l_conv"), F.col("id").alias("l_id"), F.col("layer").alias("from"))
        up = here.join(new, F.col("conv").eqNullSafe(F.col("l_conv")) & (F.col("parent") == F.col("l_id")))
        up = up.groupBy(F.col("conv").alias("u_conv"), F.col("child").alias("u_id")).agg(
            F.count(F.lit(1)).alias("met"), F.max(F.col("from") + F.col("forward")).alias("to"))
        step = state.join(up, F.col("conv").eqNullSafe(F.col("u_conv")) & (F.col("id") == F.col("u_id")), "left")
        state = common.stage(step.select("conv", "id", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"),
                                         F.greatest("layer", "to").alias("layer"),
                                         (F.col("met").isNotNull() & (F.col("open") == F.col("met"))).alias("fresh")), "layer")
    layer = state.join(raised, F.col("conv").eqNullSafe(F.col("b_conv"))).select(
        F.col("conv").alias("l_conv"), F.col("id").alias("l_id"), (F.col("open") > 0).alias("cyclic"),
        F.when(F.col("open") > 0, F.col("bound") + 1).otherwise(F.col("layer")).alias("layer"))
    out = out.join(layer, F.col("conv").eqNullSafe(F.col("l_conv")) & (F.col("call_id") == F.col("l_id")), "left")
    return out.withColumns({"layer": F.coalesce("layer", F.lit(0)), "cyclic": F.coalesce("cyclic", F.lit(False))}).drop("l_conv", "l_id")


def serialise(ordered: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """`ordered` without arguments, content and needs, plus valid, errors and json."""
    common.ship(ordered.sparkSession)
    kept = [c for c in ordered.columns if c not in ("arguments", "content", "needs")]
    schema = T.StructType([ordered.schema[c] for c in kept] + [
        T.StructField("valid", T.BooleanType()), T.StructField("errors", T.StringType()), T.StructField("json", T.StringType())])
    at = {c: i for i, c in enumerate(ordered.columns)}
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                get = lambda c: part.column(at[c]).to_pylist()  # noqa: B023, E731
                rows = [one(*r) for r in zip(*map(get, ("call_id", "pos", "name", "arguments", "needs", "result_pos", "content",
                                                        "status", "n_missing")))]
                valid, errors, text = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(at[c]) for c in kept] + [
                    pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(text, pa.string())], names=names)

    def one(call_id, pos, name, arguments, needs, result_pos, content, status, n_missing):
        is_call, value, errors = status in ("linked", "unanswered") or status == "no_id" and pos is not None, None, []
        if is_call:
            try:
                value = parse(arguments)
                errors = violations(value, schemas[name]) if name in schemas else [f"$: no schema for {name}"]
            except (ValueError, RecursionError):
                errors = ["$: not JSON"]
            errors += ["needs: missing"] * (n_missing > 0)
        record = {"call": {"arguments": value, "id": call_id, "name": name, "needs": needs or [], "turn": pos} if is_call else None,
                  "result": {"content": content, "id": call_id, "turn": result_pos} if result_pos is not None else None}
        return is_call and not errors, "; ".join(errors), canonical(record)

    return ordered.mapInArrow(run, schema)


def tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Link, order, validate and serialise; sort by conv, cyclic, layer, pos, call_id to
    read each conversation in topological order."""
    return serialise(order(common.stage(link(calls, results), "linked")), schemas)
