"""From a plan to DataFrames: every node is checked against the types of its inputs and becomes a
lazy DataFrame; only control nodes and stored nodes run anything on the way."""

from __future__ import annotations

from dataclasses import dataclass, field

import loomwork.operators.control
import loomwork.operators.documents
import loomwork.operators.graph
import loomwork.operators.lifecycle
import loomwork.operators.relational  # noqa: F401  the imports fill the registry
from loomwork.functions.canonical import digest
from loomwork.operators.base import REGISTRY, Value
from loomwork.plans.ir import PlanFault, check_structure, parse_plan, reaches
from loomwork.plans.types import TypeFault


@dataclass
class Compiled:
    result: Value
    values: dict[str, dict[str, Value]]
    order: list[str]
    identity: str
    notes: list[tuple[str, str]] = field(default_factory=list)


def compile_plan(plan: dict | str | bytes, inputs: dict[str, Value], contract: dict | None = None) -> Compiled:
    """inputs: a value for each external input of the plan."""
    if not isinstance(plan, dict):
        plan = parse_plan(plan)
    order = check_structure(plan)
    if missing := set(plan["external_inputs"]) - set(inputs):
        raise PlanFault(f"no value for inputs {sorted(missing)}")
    nodes = {n["id"]: n for n in plan["nodes"]}
    _check_releases(nodes)
    limits = {"max_node_instances": 4096, "max_loop_iterations": 16, **plan.get("limits", {})}
    values = run_scope(plan["nodes"], order, inputs, {}, contract, limits)
    return Compiled(resolve(plan["result"], values, inputs, {}), values, order, execution_identity(plan))


def run_scope(nodes: list[dict], order: list[str], inputs: dict, bound: dict, contract: dict | None, limits: dict) -> dict[str, dict[str, Value]]:
    by_id = {n["id"]: n for n in nodes}
    values: dict[str, dict[str, Value]] = {}
    for name in order:
        n = by_id[name]
        f = REGISTRY.get((n["operator"], n["implementation"]))
        if f is None:
            raise PlanFault(f"no implementation {n['operator']}:{n['implementation']}")
        own = {k: resolve(r, values, inputs, bound) for k, r in n["inputs"].items()}
        params = dict(n["params"])
        if n["operator"] == "emit" and contract:
            params["contract"] = contract
        if "regions" in n:
            params["__regions"] = n["regions"]
            params["__resolve"] = lambda r: resolve(r, values, inputs, bound)
            params["__limits"] = limits
        try:
            out = f(own, params)
        except (TypeFault, KeyError) as e:
            raise PlanFault(f"{name}: {e}") from e
        if set(out) != set(n["outputs"]):
            raise PlanFault(f"{name} has outputs {sorted(out)}, declared are {sorted(n['outputs'])}")
        for port, declared in n["outputs"].items():
            if declared.split("[")[0] != out[port].type.kind:
                raise PlanFault(f"{name}.{port} is {out[port].type.kind}, declared is {declared}")
        values[name] = out
    return values


def resolve(ref: str, values: dict, inputs: dict, bound: dict) -> Value:
    head, _, tail = ref.partition(".")
    if head == "$input":
        return inputs[tail]
    if head == "$bound":
        return bound[tail]
    return values[head][tail]


def _check_releases(nodes: dict[str, dict]) -> None:
    """A release must come after all other users of what it releases."""
    needs = {k: {r.split(".")[0] for r in n["inputs"].values() if not r.startswith("$")} | {a.split(".")[0] for a in n.get("after", [])} for k, n in nodes.items()}
    for k, n in nodes.items():
        if n["operator"] == "release":
            ref = n["inputs"]["artifact"]
            for other, m in nodes.items():
                if other != k and ref in m["inputs"].values() and not reaches(needs, other, k):
                    raise PlanFault(f"{k} may release {ref} before {other} has used it")


def comparison_identity(task: dict) -> str:
    """What must be equal for two runs to be compared: the task, not the plan."""
    return digest({"task": task})


def execution_identity(plan: dict, repeat: int = 0) -> str:
    return digest({"plan": plan, "repeat": repeat})
