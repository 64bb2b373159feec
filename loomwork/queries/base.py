"""The catalogue of queries, and how they reach tables and operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import loomwork.plans.compiler  # noqa: F401  fills the registry
from loomwork.operators.base import REGISTRY, Value
from loomwork.sources.registry import Registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Source order of each table.
ORDER = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "customer": ["c_custkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"], "embeddings": ["vec_id"]}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(spark: SparkSession, sf_dir: str, name: str, indexes: list | None = None) -> Value:
    return Registry(spark).parquet(name, f"{sf_dir}/{name}.parquet", order=ORDER[name], indexes=indexes)


def op(operator: str, implementation: str, inputs: dict[str, Value], params: dict) -> Value:
    """The single result of an operator."""
    return next(iter(REGISTRY[operator, implementation](inputs, params).values()))


def scan(spark: SparkSession, sf_dir: str, name: str, columns: list[str], predicate: dict | None = None, implementation: str = "sequential") -> Value:
    params = {"columns": columns} | ({"predicate": predicate} if predicate else {})
    indexes = [{"id": "by_key", "kind": "range", "fields": columns[:1]}]
    return op("scan", implementation, {"source": source(spark, sf_dir, name, indexes)}, params)
