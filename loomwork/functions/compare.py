"""Comparisons and small numeric rules used by validation and by domain queries."""

from __future__ import annotations

import json
from collections.abc import Callable
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

ABSOLUTE, RELATIVE = 0.005, 1e-4


def tolerant_equal(a: Column, b: Column) -> Column:
    """Numbers within max(ABSOLUTE, RELATIVE * |b|); null equals null."""
    near = F.abs(a - b) <= F.greatest(F.lit(ABSOLUTE), F.lit(RELATIVE) * F.abs(b))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


def tolerant_equal_values(a, b, nested: bool = True) -> bool:
    """The same for driver-side values; lists are multisets (without nested only the outermost, and
    rows within go by place), objects by key, bool is no number."""
    if isinstance(a, bool) or isinstance(b, bool):
        return type(a) is type(b) and a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b if isinstance(a, int) and isinstance(b, int) else abs(a - b) <= max(ABSOLUTE, RELATIVE * abs(b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(tolerant_equal_values(a[k], b[k], nested) for k in a)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        rest = list(b)
        for x in a:
            hit = next((i for i, y in enumerate(rest) if (tolerant_equal_values(x, y) if nested else _by_place(x, y))), None)
            if hit is None:
                return False
            rest.pop(hit)
        return not rest
    return type(a) is type(b) and a == b


def _by_place(a, b) -> bool:
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(_by_place, a, b))
    return tolerant_equal_values(a, b, False)


def equal_json(how: str) -> Callable:
    """A column function of two JSON texts: outer_multiset, all_multisets or canonical equality."""
    rule = {"outer_multiset": lambda a, b: tolerant_equal_values(a, b, False), "all_multisets": tolerant_equal_values, "canonical": canonical_equal}[how]

    @F.pandas_udf(BooleanType())
    def equal(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([rule(json.loads(x), json.loads(y)) for x, y in zip(a, b)], dtype=bool)

    return equal


def canonical_equal(a, b) -> bool:
    """Byte-exact: 1, 1.0 and true all differ."""
    from loomwork.functions.canonical import canonical_json

    return type(a) is type(b) and canonical_json(a) == canonical_json(b)


def scrub(c: Column) -> Column:
    """Null instead of a number that is not finite."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or zero."""
    return F.when(b != 0, a / b)


def saturating_difference(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), a - b)


def rate(numerator: Column, denominator: Column) -> Column:
    """(value, numerator, denominator, status); without a denominator nothing was applicable."""
    some = denominator > 0
    return F.struct(F.when(some, numerator / denominator).alias("value"), numerator.alias("numerator"), denominator.alias("denominator"), F.when(some, "MEASURED").otherwise("NOT_APPLICABLE").alias("status"))


def pass_k(successes: int, n: int, k: int) -> float | None:
    """The share of k-subsets of n attempts that hold successes only."""
    return comb(successes, k) / comb(n, k) if 0 < k <= n else None


def pass_k_column(s: Column, n: Column, k: int) -> Column:
    product = F.lit(1.0)
    for i in range(k):
        product = product * F.greatest(s - i, F.lit(0)) / (n - i)
    return F.when(n >= k, product)


def state_difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are missing, unexpected or changed, with what happened to them."""
    rest = [c for c in expected.columns if c not in keys]
    e, a = expected.alias("e"), actual.alias("a")
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
    marked = e.withColumn("__e", F.lit(True)).alias("e").join(a.withColumn("__a", F.lit(True)).alias("a"), on, "full")
    same = F.lit(True)
    for c in rest:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}"))
    what = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(~same, "changed")
    return marked.select(*[F.coalesce(F.col(f"e.{k}"), F.col(f"a.{k}")).alias(k) for k in keys], what.alias("difference")).where("difference is not null")
