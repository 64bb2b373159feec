"""What operators take and give: a value with its type, and the table of implementations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.plans.types import Type, TypeFault

#: The column that keeps a source's order of rows, which Spark itself does not.
ORD = "__ord"


@dataclass
class Value:
    """data: a DataFrame, a GraphData, a Python scalar, or a driver-side object."""

    data: Any
    type: Type
    notes: dict = field(default_factory=dict)

    @property
    def df(self) -> DataFrame:
        if not isinstance(self.data, DataFrame):
            raise TypeFault(f"{self.type.kind} is not a table")
        return self.data

    def visible(self) -> DataFrame:
        """The declared columns, without the hidden order."""
        return self.df.select(*[F.col(f"`{n}`") for n, _ in self.type.rows]) if self.type.rows else self.df.drop(ORD)


@dataclass
class GraphData:
    """nodes (id, ...) and edges (source, target, ...); names of the ends are the type's."""

    nodes: DataFrame
    edges: DataFrame
    source: str = "source"
    target: str = "target"
    relation: str | None = "relation"


Implementation = Callable[[dict[str, Value], dict], dict[str, Value]]
REGISTRY: dict[tuple[str, str], Implementation] = {}


def implements(operator: str, *names: str) -> Callable[[Callable], Callable]:
    """Register f(inputs, params, name) for each implementation name of an operator."""

    def add(f: Callable) -> Callable:
        for name in names:
            REGISTRY[operator, name] = lambda inputs, params, f=f, name=name: f(inputs, params, name)
        return f

    return add


def take(params: dict, required: dict[str, type | tuple], optional: dict[str, type | tuple] | None = None) -> dict:
    """Check parameter names and types exactly (a bool is no int)."""
    optional = optional or {}
    for name in params:
        if name not in required and name not in optional:
            raise TypeFault(f"PARAMETER_UNKNOWN {name}")
    for name, kind in {**required, **optional}.items():
        if name not in params:
            if name in required:
                raise TypeFault(f"PARAMETER_MISSING {name}")
            continue
        v = params[name]
        if not isinstance(v, kind) or (isinstance(v, bool) and kind is int):
            raise TypeFault(f"PARAMETER_TYPE {name}")
    return params


def whole(params: dict, name: str, least: int, most: int | None = None) -> int:
    v = params[name]
    if v < least or (most is not None and v > most):
        raise TypeFault(f"PARAMETER_RANGE {name}")
    return v


def one_of(params: dict, name: str, allowed: set) -> str:
    if params[name] not in allowed:
        raise TypeFault(f"PARAMETER_ENUM {name}={params[name]!r}")
    return params[name]


def quoted(name: str):
    return F.col(f"`{name}`")


def with_order(df: DataFrame, *keys: str) -> DataFrame:
    """Give rows their source order: by the named key columns, or as the files list them."""
    if ORD in df.columns:
        return df
    if keys:
        return df.withColumn(ORD, F.struct(*[F.col(k) for k in keys]))
    return df.withColumn(ORD, F.monotonically_increasing_id())
