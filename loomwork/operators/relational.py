"""Relational operators. The declared implementation becomes a hint or is recorded; Catalyst and
adaptive execution choose how to run."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.base import ORD, Value, implements, one_of, quoted, take, whole, with_order
from loomwork.plans.predicates import analyze
from loomwork.plans.types import Type, TypeFault, like_rows, nullable, scalar, stream, table

JOIN_TYPES = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
AGGREGATES = {"count", "sum", "min", "max", "mean"}


def _boolean(tree, row: Type) -> Column:
    e = analyze(tree, row)
    if e.type.base.kind != "Bool":
        raise TypeFault("TYPE_MISMATCH a predicate is Bool")
    return e.column()


def _columns(t: Type, names) -> list[tuple[str, Type]]:
    if not isinstance(names, list) or not names or len(set(names)) != len(names):
        raise TypeFault("PARAMETER_RANGE columns are distinct and at least one")
    return [(n, t.column(n)) for n in names]


def sort_keys(keys: list[dict], row: Type) -> list[Column]:
    """Sort columns with nulls where declared, whatever the direction (last if not said)."""
    out = []
    if not keys:
        raise TypeFault("PARAMETER_RANGE keys")
    for k in keys:
        if set(k) - {"field", "direction", "nulls"}:
            raise TypeFault("PARAMETER_UNKNOWN in keys")
        kind = row.column(k["field"])
        if not kind.is_scalar:
            raise TypeFault("TYPE_MISMATCH sort keys are scalars")
        down, first = k.get("direction", "asc") == "desc", k.get("nulls", "last") == "first"
        c = quoted(k["field"])
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return out


# --- scan, filter, project -----------------------------------------------------------------------
@implements("scan", "sequential", "index_range")
def scan(inputs: dict, params: dict, name: str) -> dict:
    """The predicate sees the whole row; columns are cut afterwards. Both reach the file scan:
    index_range asks for a declared range or sorted index, which for Parquet means row groups are
    skipped by their minima and maxima."""
    take(params, {"columns": list}, {"predicate": dict})
    source = inputs["source"]
    row = source.type.item if source.type.kind == "DatasetRef" else source.type
    if name == "index_range" and not any(i.get("kind") in ("range", "sorted") for i in row.metadata.get("indexes", [])):
        raise TypeFault("INDEX_REQUIRED")
    kept = _columns(row, params["columns"])
    df = source.df
    if "predicate" in params:
        df = df.where(_boolean(params["predicate"], row))
    df = with_order(df)  # after the predicate, which must reach the scan
    return {"rows": Value(df.select(*[quoted(n) for n, _ in kept], ORD), stream(kept, domain=row.domain, revision=row.revision))}


@implements("filter", "scalar", "vectorized")
def filter_rows(inputs: dict, params: dict, name: str) -> dict:
    take(params, {"predicate": dict}, {"batch_rows": int})
    rows = inputs["rows"]
    return {"rows": Value(rows.df.where(_boolean(params["predicate"], rows.type)), rows.type)}


@implements("project", "column_view", "copy")
def project(inputs: dict, params: dict, name: str) -> dict:
    take(params, {"columns": list})
    rows = inputs["rows"]
    kept = _columns(rows.type, params["columns"])
    hidden = [ORD] if ORD in rows.df.columns else []
    return {"rows": Value(rows.df.select(*[quoted(n) for n, _ in kept], *hidden), like_rows(rows.type, kept))}


# --- join ----------------------------------------------------------------------------------------
def joined_schema(left: Type, right: Type, how: str) -> list[tuple[str, str, str, Type]]:
    """(side, column, output name, type): both keys stay; only names on both sides get a prefix."""
    both = {n for n, _ in left.rows} & {n for n, _ in right.rows}
    sides = [("left", left)] if how in ("semi", "anti") else [("left", left), ("right", right)]
    out = []
    for side, t in sides:
        widen = how == "full" or (how == "left" and side == "right") or (how == "right" and side == "left")
        for n, kind in t.rows:
            name = f"{side}.{n}" if n in both and len(sides) == 2 else n
            out.append((side, n, name, nullable(kind) if widen else kind))
    return out


@implements("join", "hash", "sort_merge", "block_nested")
def join(inputs: dict, params: dict, name: str) -> dict:
    """Equi joins by SQL equality: null keys match nothing. hash asks for a shuffled hash join with
    the declared build side, which spills and does not grow the driver; sort_merge for a merge
    join. block_nested is a request about pairs, not about results, and an equi join never needs
    all pairs, so it is recorded and left to the optimizer."""
    take(params, {"keys": list, "join_type": str}, {"build_side": str})
    how = one_of(params, "join_type", set(JOIN_TYPES))
    left, right = inputs["left"], inputs["right"]
    if not params["keys"]:
        raise TypeFault("PARAMETER_RANGE keys")
    a, b = left.visible(), right.visible()
    a, b = a.toDF(*[f"l{i}" for i in range(len(a.columns))]), b.toDF(*[f"r{i}" for i in range(len(b.columns))])
    place = {"left": [n for n, _ in left.type.rows], "right": [n for n, _ in right.type.rows]}
    condition = None
    for k in params["keys"]:
        x, y = left.type.column(k["left"]), right.type.column(k["right"])
        if not x.is_scalar or x.base != y.base:
            raise TypeFault("TYPE_MISMATCH join keys have one scalar type")
        same = a[f"l{place['left'].index(k['left'])}"] == b[f"r{place['right'].index(k['right'])}"]
        condition = same if condition is None else condition & same
    if name == "hash":
        build = one_of(params, "build_side", {"left", "right"}) if "build_side" in params else "right"
        a, b = (a.hint("shuffle_hash"), b) if build == "left" else (a, b.hint("shuffle_hash"))
    elif name == "sort_merge":
        b = b.hint("merge")
    out = a.join(b, condition, JOIN_TYPES[how])
    columns = joined_schema(left.type, right.type, how)
    df = out.select(*[F.col(f"{side[0]}{place[side].index(n)}").alias(alias) for side, n, alias, _ in columns])
    return {"rows": Value(df, table([(alias, kind) for _, _, alias, kind in columns]), {"declared": name})}


# --- aggregate -----------------------------------------------------------------------------------
@implements("aggregate", "hash_group", "sorted_group")
def aggregate(inputs: dict, params: dict, name: str) -> dict:
    """group_by may be empty. count without a field counts rows, with one the values that are not
    null. Sums of Int64 raise on overflow."""
    take(params, {"aggregates": list}, {"group_by": list})
    rows, groups = inputs["rows"], params.get("group_by", [])
    keys = _columns(rows.type, groups) if groups else []
    made, types = [], list(keys)
    for a in params["aggregates"]:
        f, field_name = a["function"], a.get("field")
        if f not in AGGREGATES or (field_name is None and f != "count"):
            raise TypeFault(f"PARAMETER_ENUM {f}")
        kind = rows.type.column(field_name) if field_name is not None else None
        if f in ("sum", "mean") and not kind.is_numeric:
            raise TypeFault(f"TYPE_MISMATCH {f} of {kind.kind}")
        if any(a["as"] == n for n, _ in types):
            raise TypeFault("PARAMETER_RANGE names repeat")
        c = quoted(field_name) if field_name is not None else F.lit(1)
        made.append({"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg}[f](c).alias(a["as"]))
        result = scalar("Int64") if f == "count" else scalar("Float64") if f == "mean" else kind.base
        types.append((a["as"], nullable(result) if f != "count" and (not keys or kind.nullable) else result))
    if not made:
        raise TypeFault("PARAMETER_RANGE aggregates")
    df = rows.df.groupBy(*[quoted(n) for n, _ in keys]).agg(*made)
    return {"rows": Value(df, table(types))}


# --- order ---------------------------------------------------------------------------------------
@implements("sort", "in_memory", "external_merge")
def sort(inputs: dict, params: dict, name: str) -> dict:
    """A total order: ties of all keys keep the source order, also under desc."""
    take(params, {"keys": list})
    rows = inputs["rows"]
    df = with_order(rows.df)
    return {"rows": Value(df.orderBy(*sort_keys(params["keys"], rows.type), F.col(ORD).asc()), table(rows.type.rows))}


@implements("top_k", "full_sort", "streaming_heap")
def top_k(inputs: dict, params: dict, name: str) -> dict:
    """Both run as one node that keeps k rows per partition. k = 0 gives no rows but still reads its
    input to the end, so that a faulty source is found."""
    take(params, {"keys": list, "k": int})
    rows, k = inputs["rows"], whole(params, "k", 0)
    df = with_order(rows.df)
    order = [*sort_keys(params["keys"], rows.type), F.col(ORD).asc()]
    if k == 0:
        seen = F.xxhash64(*df.columns)
        read = df.agg(F.min(seen).alias("__lo"), F.max(seen).alias("__hi")).where("__lo > __hi")  # no row, but all are read
        none = read.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
        return {"rows": Value(none, table(rows.type.rows))}
    return {"rows": Value(df.orderBy(*order).limit(k), table(rows.type.rows))}


@implements("deduplicate", "hash", "sort_unique")
def deduplicate(inputs: dict, params: dict, name: str) -> dict:
    """The first or last row of each key in source order: an aggregate with a map-side combine, so
    a key that very many rows share is not gathered."""
    take(params, {"keys": list, "keep": str})
    keep, rows = one_of(params, "keep", {"first", "last"}), inputs["rows"]
    keys = _columns(rows.type, params["keys"])
    df = with_order(rows.df)
    row = F.struct(*[quoted(n) for n, _ in rows.type.rows], ORD)
    pick = (F.min_by if keep == "first" else F.max_by)(row, F.col(ORD)).alias("__row")
    out = df.groupBy(*[quoted(n).alias(f"__k{i}") for i, (n, _) in enumerate(keys)]).agg(pick).select("__row.*")
    return {"rows": Value(out, rows.type)}


# --- sets ----------------------------------------------------------------------------------------
@implements("set_op", "hash", "sorted_merge")
def set_op(inputs: dict, params: dict, name: str) -> dict:
    """Set semantics on sets of one type, domain and revision; nulls equal each other."""
    take(params, {"mode": str})
    mode = one_of(params, "mode", {"union", "intersection", "difference"})
    left, right = inputs["left"], inputs["right"]
    if not left.type.same(right.type) or left.type.kind not in ("Set", "NodeSet", "IDSet"):
        raise TypeFault("TYPE_MISMATCH sets of one type, domain and revision")
    a, b = left.df.drop(ORD), right.df.drop(ORD)
    b = b.toDF(*a.columns)
    df = a.union(b).distinct() if mode == "union" else a.intersect(b) if mode == "intersection" else a.subtract(b)
    return {"items": Value(df, replace(left.type))}


def unordered_equal(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets of rows."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def last_write_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: that of the highest order value."""
    row = F.struct(*rows.columns)
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(row, F.col(order)).alias("r")).select("r.*")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> tuple[list, bool, int | None]:
    """One page of at most 1000 rows, whether more follow, and the next offset."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise TypeFault("PARAMETER_RANGE a page has 1 to 1000 rows")
    rows = df.orderBy(*order).offset(offset).limit(limit + 1).collect()
    more = len(rows) > limit
    return rows[:limit], more, offset + limit if more else None


def pages_complete(pages: DataFrame, key: str, offset: str = "offset", n: str = "n", more: str = "has_more") -> DataFrame:
    """Per key: do the pages read start at 0, follow each other without gap, and reach the end?"""
    w = Window.partitionBy(key).orderBy(offset)
    linked = pages.withColumn("__ok", F.col(offset) == F.coalesce(F.lag(F.col(offset) + F.col(n)).over(w), F.lit(0)))
    return linked.groupBy(key).agg((F.bool_and("__ok") & ~F.max_by(more, offset)).alias("complete"))
