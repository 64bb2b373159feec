"""The fourteen collection transforms on nested data, in two forms: as Column expressions over an
array column (one row holds the collection), and on DataFrames (a row per element).

A path is a list of field names and 0-based positions. Elements keep their order in arrays; the
DataFrame forms take the order from the hidden order column.
"""

from __future__ import annotations

import ast
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomwork.plans.types import TypeFault

Path = list[str | int]
COMPARE = {"eq", "ne", "ge", "le", "in", "contains"}
OPERATIONS = ("get", "parse", "rows", "filter", "project", "unique", "sort", "slice", "flatten", "concat", "sum", "count", "object", "group")


def get(value: Column, path: Path | str) -> Column:
    """Follow a path; a position past the end is an error, as is a missing field."""
    for step in [path] if isinstance(path, str) else path:
        value = F.element_at(value, step + 1 if step >= 0 else step) if isinstance(step, int) else value.getField(step)
    return value


def parse(value: Column, schema: str | None = None) -> Column:
    """JSON text to a value: of the schema, or a variant where the shape is unknown. Text that is
    no JSON but a Python literal (single quotes, None, True, tuples) is read as that; what is
    neither gives null."""
    text = F.when(F.try_parse_json(value).isNotNull(), value).otherwise(literal_json(value))
    return F.from_json(text, schema, {"mode": "PERMISSIVE"}) if schema else F.try_parse_json(text)


@F.pandas_udf(StringType())
def literal_json(values: pd.Series) -> pd.Series:
    """The JSON of Python literals, null for other text."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(ast.literal_eval(text.strip()), allow_nan=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return values.map(one)


def rows(columns: Column, data: Column) -> Column:
    """An array of maps from column names to values, one for each row array."""
    return F.transform(data, lambda r: F.map_from_arrays(columns, r))


def _match(x: Column, predicate: dict) -> Column:
    if set(predicate) != {"path", "cmp", "value"} or predicate["cmp"] not in COMPARE:
        raise TypeFault(f"PARAMETER_ENUM {predicate}")
    z, q, cmp = get(x, predicate["path"]), predicate["value"], predicate["cmp"]
    if cmp == "in":
        return z.isin(list(q))
    if cmp == "contains":
        return F.contains(z, F.lit(q)) if isinstance(q, str) else F.array_contains(z, q)
    return {"eq": z.eqNullSafe(F.lit(q)), "ne": ~z.eqNullSafe(F.lit(q)), "ge": z >= F.lit(q), "le": z <= F.lit(q)}[cmp]


def matches(x: Column, predicates: list[dict]) -> Column:
    return reduce(Column.__and__, [_match(x, p) for p in predicates], F.lit(True))


def filter_array(value: Column, predicates: list[dict]) -> Column:
    return F.filter(value, lambda x: matches(x, predicates))


def project_array(value: Column, fields: Path | dict[str, Path]) -> Column:
    """A scalar path per element, or an object with a path per field."""
    if isinstance(fields, dict):
        return F.transform(value, lambda x: F.struct(*[get(x, p).alias(k) for k, p in fields.items()]))
    return F.transform(value, lambda x: get(x, fields))


def unique_array(value: Column) -> Column:
    """First positions of distinct elements (equal elements are alike, so which one is kept does
    not show)."""
    return F.array_distinct(value)


def sort_array(value: Column, keys: list[dict | Path], descending: bool = False) -> Column:
    """Stable by several keys, each with its own direction: positions break ties."""
    indexed = F.transform(value, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    specs = [(k["path"], bool(k.get("descending", False))) if isinstance(k, dict) else (k, descending) for k in keys or [[]]]

    def order(a: Column, b: Column) -> Column:
        result = F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)
        for path, down in reversed(specs):
            x, y = get(a["x"], path), get(b["x"], path)
            low, high = (1, -1) if down else (-1, 1)
            result = F.when(x < y, low).when(x > y, high).otherwise(result)
        return result

    return F.transform(F.array_sort(indexed, order), lambda p: p["x"])


def slice_array(value: Column, start: int = 0, stop: int | None = None) -> Column:
    """value[start:stop] with negative positions counted from the end."""
    n = F.size(value)
    at = F.least(F.lit(start), n) if start >= 0 else F.greatest(n + start, F.lit(0))
    end = n if stop is None else F.least(F.lit(stop), n) if stop >= 0 else F.greatest(n + stop, F.lit(0))
    return F.slice(value, at + 1, F.greatest(end - at, F.lit(0)))


def flatten(value: Column) -> Column:
    return F.flatten(value)


def concat(*values: Column) -> Column:
    return F.concat(*values)


def sum_array(value: Column, path: Path, kind: str = "double") -> Column:
    return F.aggregate(value, F.lit(0).cast(kind), lambda s, x: s + get(x, path).cast(kind))


def count_array(value: Column) -> Column:
    return F.size(value).cast("long")


def make_object(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def group_rows(df: DataFrame, key: Column, value: Column | None = None, order: Column | None = None) -> DataFrame:
    """(key, count, sum), given an order in that in which keys are first seen; sum is 0 without a
    value."""
    total = F.coalesce(F.sum(value), F.lit(0)) if value is not None else F.lit(0).cast("long")
    if order is None:
        return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("count"), total.alias("sum"))
    out = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("count"), total.alias("sum"), F.min(order).alias("__first"))
    return out.orderBy("__first").drop("__first")


def group_array(value: Column, key: Path, amount: Path | None = None) -> Column:
    """The same over an array column: an array of (key, count, sum), keys as first seen."""
    keys = F.array_distinct(F.transform(value, lambda x: get(x, key)))

    def one(k: Column) -> Column:
        own = F.filter(value, lambda x: get(x, key).eqNullSafe(k))
        total = sum_array(own, amount) if amount is not None else F.lit(0.0)
        return F.struct(k.alias("key"), F.size(own).cast("long").alias("count"), total.alias("sum"))

    return F.transform(keys, one)


def transform(op: str, collection: Column | None = None, /, **a) -> Column:
    """One transform by name, with the arguments that workflow nodes give."""
    if op not in OPERATIONS:
        raise TypeFault(f"unknown transform {op!r}")
    path = a.get("path", [])
    return {
        "get": lambda: get(collection, path),
        "parse": lambda: parse(collection, a.get("schema")),
        "rows": lambda: rows(collection["columns"], collection["rows"]),
        "filter": lambda: filter_array(collection, a["predicates"]),
        "project": lambda: project_array(collection, a["fields"]),
        "unique": lambda: unique_array(collection),
        "sort": lambda: sort_array(collection, a.get("keys", [[]]), a.get("descending", False)),
        "slice": lambda: slice_array(collection, a.get("start", 0), a.get("stop")),
        "flatten": lambda: flatten(collection),
        "concat": lambda: concat(*a["inputs"]),
        "sum": lambda: sum_array(collection, path),
        "count": lambda: count_array(collection),
        "object": lambda: make_object(**a["fields"]),
        "group": lambda: group_array(collection, a["key"], a.get("value")),
    }[op]()
