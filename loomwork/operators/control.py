"""Regions: per-record maps, branches and bounded loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators.base import ORD, Value, implements, take, whole
from loomwork.plans.predicates import analyze
from loomwork.plans.types import Type, TypeFault, merge_branches, stream
from loomwork.sources.storage import store


def _own(params: dict) -> dict:
    return {k: v for k, v in params.items() if not k.startswith("__")}


def _run(region: dict, bound: dict[str, Value], limits: dict) -> dict[str, Value]:
    from loomwork.plans.compiler import resolve, run_scope
    from loomwork.plans.ir import topological

    ids = {n["id"] for n in region["nodes"]}
    needs = {n["id"]: {r.split(".")[0] for r in n["inputs"].values()} & ids for n in region["nodes"]}
    values = run_scope(region["nodes"], topological(needs), {}, bound, None, limits)
    return {k: resolve(r, values, {}, bound) for k, r in region["yield"].items()}


@implements("map", "bounded_map")
def bounded_map(inputs: dict, params: dict, name: str) -> dict:
    """The region sees one record; its nodes are row-wise, so it runs on all records at once. At
    most max_node_instances records are allowed, checked before anything else runs."""
    take(_own(params), {})
    rows, region, limits = inputs["rows"], params["__regions"]["body"], params["__limits"]
    record = Type("Record", schema=rows.type.rows)
    item = Value(rows.df, stream(record.schema))
    bound = {b: item if r == "$item" else params["__resolve"](r) for b, r in region["bindings"].items()}
    allowed = {"filter", "project"}
    if any(n["operator"] not in allowed for n in region["nodes"]):
        raise TypeFault("a map region holds row-wise operators only")
    most = limits["max_node_instances"]
    if rows.df.limit(most + 1).count() > most:
        raise TypeFault("INSTANCE_LIMIT")
    out = _run(region, bound, limits)
    port, value = next(iter(out.items()))
    return {"rows" if port == "record" else port: Value(value.df, stream(value.type.rows))}


def _truth(tree: dict, row: Type, value: Value) -> bool:
    """The condition's value on the driver; unknown is an error."""
    e = analyze(tree, row)
    if e.type.base.kind != "Bool":
        raise TypeFault("TYPE_MISMATCH a condition is Bool")
    got = [r[0] for r in value.df.select(e.column()).limit(2).collect()]
    if len(got) != 1:
        raise TypeFault("a condition reads one record")
    if got[0] is None:
        raise TypeFault("CONDITION_UNKNOWN")
    return got[0]


@implements("branch", "predicate_branch")
def branch(inputs: dict, params: dict, name: str) -> dict:
    """Only the chosen arm runs; both arms must give the same types but for nullability."""
    own = take(_own(params), {"predicate": dict})
    regions, limits = params["__regions"], params["__limits"]
    named = {k: v for k, v in inputs.items()}
    first = next(iter(named.values()))
    if first.type.base.kind == "Bool":
        row = Type("Record", schema=tuple((k, v.type) for k, v in named.items()))
        spark = _spark()
        value = Value(spark.range(1).select(*[F.lit(v.data).cast("boolean").alias(k) for k, v in named.items()]), row)
    else:
        row, value = Type("Record", schema=first.type.rows), first
    take_then = _truth(own["predicate"], row, value)
    outs = {}
    for arm in ("then", "else"):
        bound = {b: params["__resolve"](r) for b, r in regions[arm]["bindings"].items()}
        outs[arm] = _run(regions[arm], bound, limits)  # lazy: the arm not taken never executes
    chosen, other = (outs["then"], outs["else"]) if take_then else (outs["else"], outs["then"])
    return {k: Value(v.data, merge_branches(v.type, other[k].type), v.notes) for k, v in chosen.items()}


@implements("loop", "bounded_loop")
def loop(inputs: dict, params: dict, name: str) -> dict:
    """state -> state while the condition holds, checked first and after every update. A condition
    that still holds at the cap is an error, not a result. The state is stored after each turn."""
    own = take(_own(params), {"condition": dict, "max_iterations": int})
    region, limits = params["__regions"]["body"], params["__limits"]
    cap = whole(own, "max_iterations", 0, min(16, limits["max_loop_iterations"]))
    state = inputs["state"]
    row = Type("Record", schema=state.type.rows)
    for turn in range(cap + 1):
        if not _truth(own["condition"], row, state):
            return {"state": state}
        if turn == cap:
            break
        bound = {b: state if r == "$state" else params["__resolve"](r) for b, r in region["bindings"].items()}
        new = next(iter(_run(region, bound, limits).values()))
        if [n for n, _ in new.type.rows] != [n for n, _ in state.type.rows]:
            raise TypeFault("TYPE_MISMATCH a loop keeps the type of its state")
        state = Value(store(new.df.drop(ORD), "state"), state.type)
    raise TypeFault("LOOP_LIMIT_REACHED")


def repeat_until(state, condition, update, cap: int):
    """The same rule for Python callables: condition(state) -> bool or None, update(state)."""
    for turn in range(cap + 1):
        holds = condition(state)
        if holds is None:
            raise TypeFault("CONDITION_UNKNOWN")
        if not holds:
            return state
        if turn < cap:
            state = update(state)
    raise TypeFault("LOOP_LIMIT_REACHED")


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.active()


