"""Expressions: a closed tree, analysed against a row type, then built as a Column.

Three-valued logic as in SQL, with two differences that plans rely on: `and` and `or` evaluate all
operands, so an operand that fails is not hidden by another one that decides (built as forall and
exists over an array; only where an operand can fail, else the plain operators, which sources can
push down); and arithmetic that leaves the finite range is an error.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.plans.types import Type, TypeFault, nullable, scalar

MAX_DEPTH, MAX_NODES = 64, 4096
COMPARE = {"eq", "ne", "lt", "le", "gt", "ge"}
ARITHMETIC = {"add", "sub", "mul", "div"}
NULL, EMPTY = Type("Null"), Type("Empty")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}$")
_TIMESTAMP = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$")
INT64 = range(-(1 << 63), 1 << 63)


def literal_type(v) -> Type:
    if v is None:
        return NULL
    if isinstance(v, bool):
        return scalar("Bool")
    if isinstance(v, int):
        if v not in INT64:
            raise TypeFault("integer literal out of range")
        return scalar("Int64")
    if isinstance(v, float):
        if not math.isfinite(v):
            raise TypeFault("literal is not finite")
        return scalar("Float64")
    if isinstance(v, str):
        return scalar("Utf8")
    if isinstance(v, list):
        kinds = {literal_type(x) for x in v if x is not None}
        if any(k.kind in ("List", "Empty", "Null") for k in kinds) or len(kinds) > 1:
            raise TypeFault("a literal list is flat and of one type")
        if not kinds:
            return EMPTY if not v else Type("List", item=NULL)
        item = kinds.pop()
        return Type("List", item=nullable(item) if None in v else item)
    raise TypeFault(f"no literal of {type(v).__name__}")


def _temporal(v, want: str):
    """A literal typed by the other side of a comparison."""
    if want == "Date" and isinstance(v, str) and _DATE.match(v):
        return dt.date.fromisoformat(v)
    if want == "Timestamp" and isinstance(v, str) and _TIMESTAMP.match(v):
        return dt.datetime.fromisoformat(v.replace("Z", "+00:00"))
    raise TypeFault(f"{v!r} is no {want} literal")


class Expression:
    """An analysed expression: its type, whether it can fail at run time, and its Column."""

    def __init__(self, type_: Type, build, can_fail: bool = False):
        self.type, self._build, self.can_fail = type_, build, can_fail

    def column(self) -> Column:
        return self._build()


def fields_of(tree) -> set[str]:
    """The names of all fields that a predicate reads."""
    if isinstance(tree, dict):
        if set(tree) == {"field"}:
            return {tree["field"]}
        return set().union(*(fields_of(v) for k, v in tree.items() if k != "literal"))
    return set().union(*map(fields_of, tree)) if isinstance(tree, list) else set()


def analyze(tree, row: Type) -> Expression:
    """Check a tree against the row type of its input; raises TypeFault."""
    counter = [0]

    def walk(t, depth: int) -> Expression:
        counter[0] += 1
        if depth > MAX_DEPTH or counter[0] > MAX_NODES:
            raise TypeFault("expression too large")
        if not isinstance(t, dict):
            raise TypeFault(f"not an expression: {t!r}")
        if set(t) == {"field"}:
            kind = row.column(t["field"])
            return Expression(kind, lambda: F.col(f"`{t['field']}`"))
        if set(t) == {"literal"}:
            value = t["literal"]
            e = Expression(literal_type(value), lambda: F.lit(value) if not isinstance(value, list) else F.array(*map(F.lit, value)))
            e.value = value  # type: ignore[attr-defined]
            return e
        op = t.get("op")
        shape = {"op", "args"} if op in ("and", "or") else {"op", "arg"} if op in ("not", "is_null", "count") else {"op", "left", "right"}
        if set(t) != shape:
            raise TypeFault(f"{op} takes exactly {sorted(shape)}")
        parts = t["args"] if "args" in t else [t["arg"]] if "arg" in t else [t["left"], t["right"]]
        if not isinstance(parts, list):
            raise TypeFault(f"the operands of {op} are a list")
        args = [walk(a, depth + 1) for a in parts]
        fails = any(a.can_fail for a in args)
        if op in ("and", "or"):
            if len(args) < 2:
                raise TypeFault(f"{op} takes two or more operands")
            for a in args:
                _want(a, {"Bool", "Null"})
            kind = nullable(scalar("Bool")) if any(a.type.nullable or a.type == NULL for a in args) else scalar("Bool")
            return Expression(kind, lambda: junction(op, [a.column() for a in args], eager=fails), fails)
        if op == "not":
            _arity(op, args, 1)
            _want(args[0], {"Bool", "Null"})
            return Expression(args[0].type if args[0].type != NULL else nullable(scalar("Bool")), lambda: ~args[0].column().cast("boolean"), fails)
        if op == "is_null":
            _arity(op, args, 1)
            return Expression(scalar("Bool"), lambda: args[0].column().isNull(), fails)
        if op == "count":
            _arity(op, args, 1)
            if args[0].type.base.kind not in ("List", "Set"):
                raise TypeFault("count takes a collection")
            kind = nullable(scalar("Int64")) if args[0].type.nullable else scalar("Int64")
            return Expression(kind, lambda: F.when(args[0].column().isNotNull(), F.size(args[0].column()).cast("long")), fails)
        if op in COMPARE:
            return _compare(op, args, fails)
        if op == "in":
            return _member(args, fails)
        if op in ARITHMETIC:
            return _arithmetic(op, args)
        raise TypeFault(f"unknown operator {op!r}")

    return walk(tree, 1)


def _arity(op: str, args: list, n: int) -> None:
    if len(args) != n:
        raise TypeFault(f"{op} takes {n} operands")


def _want(e: Expression, kinds: set[str]) -> None:
    if e.type.base.kind not in kinds:
        raise TypeFault(f"{e.type.base.kind} where {sorted(kinds)} is wanted")


def _maybe(kind: Type, *args: Expression) -> Type:
    return nullable(kind) if any(a.type.nullable or a.type == NULL for a in args) else kind


def _align(a: Expression, b: Expression) -> tuple[Expression, Expression]:
    """Give a string literal the temporal type of the other operand."""
    out = []
    for x, other in ((a, b), (b, a)):
        want = other.type.base.kind
        if want in ("Date", "Timestamp") and isinstance(getattr(x, "value", None), str):
            v = _temporal(x.value, want)
            out.append(Expression(scalar(want), lambda v=v: F.lit(v)))
        else:
            out.append(x)
    return out[0], out[1]


def _compare(op: str, args: list[Expression], fails: bool) -> Expression:
    _arity(op, args, 2)
    a, b = _align(*args)
    kinds = {x.type.base.kind for x in (a, b) if x.type != NULL}
    if len(kinds) > 1 or not all(x.type == NULL or x.type.is_scalar for x in (a, b)):
        raise TypeFault(f"cannot compare {sorted(kinds)} without a cast")
    if kinds == {"Bool"} and op not in ("eq", "ne"):
        raise TypeFault("booleans have no order")
    build = {"eq": Column.__eq__, "ne": Column.__ne__, "lt": Column.__lt__, "le": Column.__le__, "gt": Column.__gt__, "ge": Column.__ge__}[op]
    if NULL in (a.type, b.type):
        return Expression(nullable(scalar("Bool")), lambda: F.lit(None).cast("boolean"), fails)
    return Expression(_maybe(scalar("Bool"), a, b), lambda: build(a.column(), b.column()), fails)


def _member(args: list[Expression], fails: bool) -> Expression:
    _arity("in", args, 2)
    x, values = args[0], getattr(args[1], "value", None)
    if not isinstance(values, list):
        raise TypeFault("in takes a literal list")
    if not values:
        return Expression(scalar("Bool"), lambda: F.lit(False), fails)  # even for a null
    kind = args[1].type.item.base if args[1].type.item else NULL
    want = x.type.base.kind
    if want in ("Date", "Timestamp"):
        values = [None if v is None else _temporal(v, want) for v in values]
    elif kind != NULL and kind.kind != want and x.type != NULL:
        raise TypeFault(f"{want} against a list of {kind.kind}")
    known = [v for v in values if v is not None]

    def build() -> Column:
        hit = x.column().isin(known) if known else F.lit(None).cast("boolean")
        return hit | F.lit(None).cast("boolean") if len(known) < len(values) else hit

    return Expression(nullable(scalar("Bool")) if len(known) < len(values) else _maybe(scalar("Bool"), x), build, fails)


def _arithmetic(op: str, args: list[Expression]) -> Expression:
    _arity(op, args, 2)
    a, b = args
    kinds = {x.type.base.kind for x in args if x.type != NULL}
    if len(kinds) != 1 or not kinds <= {"Int64", "Float64"}:
        raise TypeFault(f"arithmetic on {sorted(kinds)}")
    kind = scalar("Float64") if op == "div" else scalar(kinds.pop())
    build = {"add": Column.__add__, "sub": Column.__sub__, "mul": Column.__mul__, "div": Column.__truediv__}[op]

    def column() -> Column:
        x, y = a.column(), b.column()
        value = build(x, y)
        return finite(value) if kind.kind == "Float64" else value

    return Expression(_maybe(kind, a, b), column, True)


def finite(value: Column) -> Column:
    """The value, or an error if it is infinite or not a number."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit("ARITHMETIC_NOT_FINITE")).cast("double")).otherwise(value)


def junction(op: str, operands: list[Column], eager: bool = True) -> Column:
    if not eager:
        return reduce(Column.__and__ if op == "and" else Column.__or__, [c.cast("boolean") for c in operands])
    every = F.array(*[c.cast("boolean") for c in operands])
    return F.forall(every, lambda x: x) if op == "and" else F.exists(every, lambda x: x)


def field(name: str) -> dict:
    return {"field": name}


def lit(value) -> dict:
    return {"literal": value}


def call(op: str, *args) -> dict:
    if op in ("and", "or"):
        return {"op": op, "args": list(args)}
    return {"op": op, "arg": args[0]} if len(args) == 1 else {"op": op, "left": args[0], "right": args[1]}
