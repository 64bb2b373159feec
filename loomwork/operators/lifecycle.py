"""Storing, sharing, releasing and giving out results."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loomwork.functions.canonical import canonical_json, digest
from loomwork.operators.base import ORD, Value, implements, one_of, quoted, take, whole, with_order
from loomwork.plans.types import Type, TypeFault, assignable, parse, stream, table
from loomwork.sources.storage import store


@implements("materialize", "memory", "disk")
def materialize(inputs: dict, params: dict, name: str) -> dict:
    """memory keeps the rows on executors (spilling, and recomputed if one is lost); disk writes
    them once to the shared folder, as Parquet or as Arrow IPC streams, one for each batch."""
    take(params, {"format": str})
    one_of(params, "format", {"arrow_ipc", "parquet"})
    rows = inputs["rows"]
    if name == "memory":
        df = rows.df.persist(StorageLevel.MEMORY_AND_DISK)
    else:
        df = store(rows.df, "rows") if params["format"] == "parquet" else store_ipc(rows.df)
    return {"rows": Value(df, table(rows.type.rows, domain=rows.type.domain, revision=rows.type.revision), {"held": name})}


def store_ipc(df: DataFrame) -> DataFrame:
    """Write the rows as Arrow IPC streams to the shared folder and read them back from there."""
    schema = df.schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["stream"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                yield from pa.ipc.open_stream(raw)

    return store(df.mapInArrow(pack, "stream binary"), "streams").mapInArrow(unpack, schema)


@implements("collect", "bounded_collect")
def collect(inputs: dict, params: dict, name: str) -> dict:
    """At most limit rows, or an error: never a silent cut."""
    take(params, {"limit": int})
    rows, limit = inputs["rows"], whole(params, "limit", 0)
    if rows.df.limit(limit + 1).count() > limit:
        raise TypeFault("COLLECT_LIMIT")
    return {"rows": Value(rows.df.limit(limit), table(rows.type.rows))}


@implements("stream_read", "arrow_batches")
def stream_read(inputs: dict, params: dict, name: str) -> dict:
    take(params, {"batch_size": int})
    size, artifact = whole(params, "batch_size", 1), inputs["artifact"]
    t = artifact.type.item if artifact.type.kind == "ArtifactRef" else artifact.type
    value = Value(artifact.df, stream(t.rows, domain=t.domain, revision=t.revision), {"batch_size": size})
    value.notes["batches"] = lambda: arrow_batches(value.visible(), size)
    return {"rows": value}


def arrow_batches(df: DataFrame, size: int) -> Iterator[pa.RecordBatch]:
    """The rows on the driver in Arrow batches of size rows, the last one shorter; one partition at
    a time is fetched."""
    schema, held = to_arrow_schema(df.schema), []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row.asDict(recursive=True))
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


@implements("broadcast", "shared_ref", "copy_each")
def broadcast(inputs: dict, params: dict, name: str) -> dict:
    """One reference per consumer. shared_ref stores the rows once for all; copy_each gives every
    consumer its own stored copy. Nothing is sent to all executors here: a join decides that by
    the size it measures."""
    take(params, {"consumers": list})
    names, artifact = params["consumers"], inputs["artifact"]
    if not names or len(set(names)) != len(names):
        raise TypeFault("PARAMETER_RANGE consumers")
    shared = store(artifact.df, "shared") if name == "shared_ref" else None
    ref = Type("ArtifactRef", item=artifact.type)
    return {n: Value(shared if shared is not None else store(artifact.df, n), ref) for n in names}


@implements("cache", "memory", "disk")
def cache(inputs: dict, params: dict, name: str) -> dict:
    take(params, {"key_fields": list})
    artifact = inputs["artifact"]
    for f in params["key_fields"]:
        artifact.type.column(f)
    level = StorageLevel.MEMORY_AND_DISK if name == "memory" else StorageLevel.DISK_ONLY
    key = digest({"columns": [n for n, _ in artifact.type.rows], "key": params["key_fields"], "plan": artifact.df._jdf.queryExecution().logical().canonicalized().hashCode()})
    return {"artifact": Value(artifact.df.persist(level), Type("ArtifactRef", item=artifact.type), {"key": key})}


@implements("release", "explicit")
def release(inputs: dict, params: dict, name: str) -> dict:
    """After the last consumer (the compiler checks that)."""
    take(params, {})
    inputs["artifact"].df.unpersist()
    return {"done": Value(True, Type("ControlToken"))}


@implements("emit", "json_artifact")
def emit(inputs: dict, params: dict, name: str) -> dict:
    """Check the public output contract; the result's data is a lazy DataFrame. `canonical` in the
    notes gives the canonical JSON of an ordered or scalar-sized result on the driver."""
    take(params, {"output_contract": str}, {"contract": dict})
    value = next(iter(inputs.values()))
    contract = params.get("contract")
    if contract:
        if contract["id"] != params["output_contract"]:
            raise TypeFault("PARAMETER_ENUM output_contract")
        schema = contract.get("schema")
        if schema is not None:
            want = table({n: parse(t) for n, t in schema.items()})
            have = table(value.type.rows)
            if not assignable(replace(have, domain=None, revision=None), want) and not _loose(have, want):
                raise TypeFault(f"OUTPUT_CONTRACT {have.rows}")
    note = {"contract": params["output_contract"], "canonical": lambda limit=100_000: to_canonical(Value(value.data, value.type).visible(), limit)}
    return {"result": Value(value.data, Type("Result", schema=value.type.rows), note)}


def _loose(have: Type, want: Type) -> bool:
    """The same columns in any order; a result may be nullable where sums over a table are."""
    mine = dict(have.rows)
    return mine.keys() == dict(want.rows).keys() and all(mine[n].base.same(t.base) for n, t in want.rows)


def to_canonical(df: DataFrame, limit: int = 100_000) -> tuple[str, str]:
    """The canonical JSON of a small result and its SHA-256; more than limit rows is an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TypeFault("COLLECT_LIMIT")
    return canonical_json([r.asDict(recursive=True) for r in rows]), digest([r.asDict(recursive=True) for r in rows])


@implements("stats", "metadata", "sample")
def stats(inputs: dict, params: dict, name: str) -> dict:
    """metadata: rows, nulls, minimum and maximum of the fields, over all rows. sample: the same
    over sample_size rows (a sampling operator): those of the lowest digests of their source order,
    so the sample is spread over the source and the same each time."""
    take(params, {"fields": list}, {"sample_size": int})
    source = inputs["source"]
    row = source.type.item if source.type.kind == "DatasetRef" else source.type
    df = source.df
    if name == "sample":
        size = whole(params, "sample_size", 1)
        df = with_order(df)
        df = df.orderBy(F.md5(F.to_json(F.struct(ORD)).cast("binary")), ORD).limit(size)
    for f in params["fields"]:
        row.column(f)
    facts = [F.count(F.lit(1)).alias("rows")]
    for f in params["fields"]:
        c = quoted(f)
        facts += [F.count_if(c.isNull()).alias(f"{f}_nulls"), F.min(c).alias(f"{f}_min"), F.max(c).alias(f"{f}_max")]
    return {"stats": Value(df.agg(*facts), Type("Stats"))}
