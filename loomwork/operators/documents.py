"""Documents: reading, retrieval, splitting, context, extraction and evidence."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.base import Value, implements, one_of, quoted, take, whole
from loomwork.plans.types import Type, TypeFault, nullable, scalar

K1, B = 1.2, 0.75
TOKEN = r"[\s]+"


def tokens(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN), lambda t: t != "")


def _id(index: Value) -> str:
    return index.type.metadata.get("id_field", "id")


@implements("read_documents", "batched", "per_document")
def read_documents(inputs: dict, params: dict, name: str) -> dict:
    """The chosen documents' fields. A table of ids has one id column, or names it."""
    take(params, {"fields": list, "batch_size": int}, {"id_field": str})
    whole(params, "batch_size", 1)
    index, ids = inputs["index"], inputs["ids"]
    kept = tuple((n, index.type.column(n)) for n in params["fields"])
    if ids.type.kind in ("Table", "Stream"):
        names = [n for n, _ in ids.type.rows]
        column = params.get("id_field") or (names[0] if len(names) == 1 else None)
        if column is None:
            raise TypeFault("PARAMETER_MISSING id_field")
    else:
        if (index.type.domain, index.type.revision) != (ids.type.domain, ids.type.revision):
            raise TypeFault("DOMAIN_MISMATCH index and ids")
        column = params.get("id_field") or ids.df.columns[0]
    wanted = ids.df.select(quoted(column).alias("__id")).distinct()
    key = _id(index)
    df = index.df.join(wanted, quoted(key) == F.col("__id"), "left_semi").select(*[quoted(n) for n, _ in kept])
    meta = {**index.type.metadata, "batch_size": params["batch_size"]}
    return {"documents": Value(df, Type("DocumentStream", schema=kept, domain=index.type.domain, revision=index.type.revision, metadata=meta))}


def _equal(q: str):
    return lambda x: x == q


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of documents with a query term. Term frequencies of the query's few terms are
    counted inside each row, so only documents that match leave the scan; document counts and
    lengths are one aggregate over the corpus."""
    terms = list(dict.fromkeys(query.lower().split()))
    rows = docs.select(quoted(id_col).alias("id"), tokens(quoted(text_col)).alias("t"))
    counted = rows.select("id", F.size("t").alias("dl"), *[F.size(F.filter("t", _equal(q))).alias(f"f{i}") for i, q in enumerate(terms)])
    facts = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        n, df = facts["n"] or 0, facts[f"d{i}"] or 0
        f = F.col(f"f{i}").cast("double")
        idf = F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.lit(float(facts["avg"] or 1.0))))
    hit = F.greatest(*[F.col(f"f{i}") for i in range(len(terms))], F.lit(0)) > 0
    return counted.where(hit).select("id", score.alias("score"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


@implements("text_retrieve", "bm25", "dense_fixed")
def text_retrieve(inputs: dict, params: dict, name: str) -> dict:
    """The best `limit` ids with ranks; ties by id. dense_fixed takes the query's vector (no model
    is called) and the index's embedding column."""
    take(params, {"limit": int}, {"query": str, "vector": list})
    index, limit = inputs["index"], whole(params, "limit", 0)
    key, meta = _id(index), index.type.metadata
    if name == "bm25":
        scored = bm25(index.df, key, meta.get("text_field", "text"), params["query"])
    else:
        if "vector" not in params:
            raise TypeFault("MODEL_UNBOUND dense retrieval needs the query's vector")
        q = F.array(*[F.lit(float(x)) for x in params["vector"]])
        scored = index.df.select(quoted(key).alias("id"), cosine(F.col(meta.get("embedding_field", "embedding")), q).alias("score")).where("score is not null")
    best = scored.orderBy(F.col("score").desc_nulls_last(), "id").limit(limit)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), "id")))  # limit rows
    return {"ids": Value(ranked, Type("RankedIDSet", item=meta.get("id_type"), domain=index.type.domain, revision=index.type.revision, metadata={"id_field": "id"}))}


def _starts(lengths: Column) -> Column:
    """Running sums of an array from 0 on, within the row: no shuffle brings pieces together again."""
    zero = F.array(F.lit(0))
    return F.aggregate(lengths, zero, lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))


def token_windows(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """(id, chunk_no, start_char, end_char, text) of windows of size words with overlap; offsets
    are code points in the document."""
    words = F.regexp_extract_all(F.coalesce(quoted(text_col), F.lit("")), F.lit(r"(\s*\S+)"), 1)  # with the space before
    base = docs.select(quoted(id_col).alias("id"), words.alias("w")).withColumn("n", F.size("w")).where("n > 0")
    step = size - overlap
    count = F.when(F.col("n") <= size, F.lit(1)).otherwise(F.ceil((F.col("n") - overlap) / F.lit(float(step))).cast("int"))
    joined = lambda at, n: F.array_join(F.slice("w", at + 1, n), "")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(joined(k * step, size).alias("raw"), F.length(joined(k * step, step)).alias("stride")))
    # a document's chunks follow each other: their starts are a running sum of the strides
    chunks = base.select("id", cut.alias("c")).select("id", "c", _starts(F.transform("c", lambda c: c["stride"])).alias("at"))
    rows = chunks.select("id", F.posexplode(F.zip_with("c", F.slice("at", F.lit(1), F.size("c")), lambda c, at: F.struct(c["raw"].alias("raw"), at.alias("at")))).alias("chunk_no", "c"))
    placed = rows.select("id", "chunk_no", "c.at", "c.raw")
    text = F.regexp_replace("raw", r"^\s+", "")
    start = F.col("at") + F.length("raw") - F.length(text)
    return placed.select("id", "chunk_no", start.alias("start_char"), (F.col("at") + F.length("raw")).alias("end_char"), text.alias("text"))


def sections(docs: DataFrame, id_col: str, text_col: str, header: str = r"\n\s*\n") -> DataFrame:
    """(id, chunk_no, start_char, end_char, text): texts cut at blank lines, offsets kept."""
    parts = F.split(F.coalesce(quoted(text_col), F.lit("")), f"(?={header})")
    cut = docs.select(quoted(id_col).alias("id"), parts.alias("p")).select("id", "p", _starts(F.transform("p", F.length)).alias("at"))
    e = cut.select("id", F.posexplode(F.zip_with("p", F.slice("at", F.lit(1), F.size("p")), lambda p, at: F.struct(p.alias("text"), at.alias("at")))).alias("chunk_no", "c"))
    return e.select("id", "chunk_no", F.col("c.at").alias("start_char"), (F.col("c.at") + F.length("c.text")).alias("end_char"), F.col("c.text").alias("text"))


@implements("split_documents", "section", "token_window")
def split_documents(inputs: dict, params: dict, name: str) -> dict:
    take(params, {"size": int, "overlap": int})
    size = whole(params, "size", 1)
    overlap = whole(params, "overlap", 0, size - 1)
    docs = inputs["documents"]
    key, text = docs.type.metadata.get("id_field", "id"), docs.type.metadata.get("text_field", "text")
    df = token_windows(docs.df, key, text, size, overlap) if name == "token_window" else sections(docs.df, key, text)
    return {"chunks": Value(df, replace(docs.type, kind="ChunkStream"))}


@implements("gather_context", "neighbors", "section_header")
def gather_context(inputs: dict, params: dict, name: str) -> dict:
    """neighbors: each chunk with the text of those up to window chunks away in its document, a
    window function over the document's chunks. section_header: with the document's first chunk."""
    take(params, {"window": int})
    n, chunks = whole(params, "window", 0), inputs["chunks"]
    w = Window.partitionBy("id").orderBy("chunk_no")
    if name == "neighbors":
        context = F.concat_ws("\n", F.collect_list("text").over(w.rowsBetween(-n, n)))
    else:
        context = F.first("text").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return {"chunks": Value(chunks.df.withColumn("context", context), chunks.type)}


@implements("semantic_extract", "fixed_e0")
def semantic_extract(inputs: dict, params: dict, name: str) -> dict:
    """A fixed extractor without a model: of each chunk's first context_budget words, `key: value`
    pairs whose key is a field of the schema, cast to its type; with the span of each value. A
    chunk gives a row if it has any of the fields."""
    take(params, {"field_schema": dict, "context_budget": int})
    budget, docs = whole(params, "context_budget", 1), inputs["documents"]
    types = {n: scalar(t) for n, t in params["field_schema"].items()}
    spark_name = {"Int64": "bigint", "Float64": "double", "Bool": "boolean", "Utf8": "string", "Date": "date", "Timestamp": "timestamp"}
    head = F.regexp_extract(F.coalesce("text", F.lit("")), rf"^(?:\s*\S+){{0,{budget}}}", 0)
    rows = docs.df.withColumn("__head", head)
    values = {n: F.nullif(F.regexp_extract("__head", rf"(?i)\b{n}\s*[:=]\s*([^\s,;]+)", 1), F.lit("")) for n in types}
    start = F.coalesce(F.col("start_char"), F.lit(0)) if "start_char" in docs.df.columns else F.lit(0)
    key = "id" if "id" in docs.df.columns else docs.type.metadata.get("id_field", "id")
    spans = [F.when(v.isNotNull(), F.struct(F.lit(n).alias("field"), quoted(key).cast("string").alias("document_id"), (start + F.instr("__head", v) - 1).alias("start_char"), (start + F.instr("__head", v) - 1 + F.length(v)).alias("end_char"), v.alias("quoted"))) for n, v in values.items()]
    found = rows.select(quoted(key).alias("__document"), *[v.try_cast(spark_name[types[n].kind]).alias(n) for n, v in values.items()], F.filter(F.array(*spans), lambda s: s.isNotNull()).alias("evidence"))
    df = found.where(F.size("evidence") > 0)
    return {"evidence": Value(df, Type("EvidenceTable", schema=tuple((n, nullable(t)) for n, t in types.items()), domain=docs.type.domain, revision=docs.type.revision))}


@implements("evidence_merge", "by_entity", "by_document")
def evidence_merge(inputs: dict, params: dict, name: str) -> dict:
    """Rows with equal keys. keep_all keeps them; reject drops keys whose rows disagree;
    declared_priority keeps the row that the rule puts first. By aggregates, never by gathering."""
    take(params, {"keys": list, "conflict_policy": str}, {"priority_rule": dict})
    policy = one_of(params, "conflict_policy", {"keep_all", "reject", "declared_priority"})
    value = inputs["evidence"]
    keys = [n for n in params["keys"] if value.type.column(n)]
    df = value.df
    if policy == "keep_all":
        return {"evidence": value}
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[quoted(c) for c in df.columns])
    if policy == "reject":
        facts = F.struct(*[quoted(c) for c in rest if c not in ("evidence", "__document")])
        merged = df.groupBy(*[quoted(k).alias(f"__{i}") for i, k in enumerate(keys)]).agg(F.min(facts).alias("lo"), F.max(facts).alias("hi"), F.any_value(row).alias("row")).where("lo <=> hi")
    else:
        rule = params.get("priority_rule") or {}
        if not rule.get("field"):
            raise TypeFault("PARAMETER_MISSING priority_rule")
        rank = F.struct(quoted(rule["field"]).alias("p"), *[quoted(c) for c in rest if c != rule["field"]])
        pick = F.max_by(row, rank) if rule.get("direction", "desc") == "desc" else F.min_by(row, rank)
        merged = df.groupBy(*[quoted(k).alias(f"__{i}") for i, k in enumerate(keys)]).agg(pick.alias("row"))
    return {"evidence": Value(merged.select("row.*"), value.type)}


@implements("evidence_validate", "span_check")
def evidence_validate(inputs: dict, params: dict, name: str) -> dict:
    """Every cited span must lie in its document and hold the quoted text. strict raises at the
    first that does not; else rows with a bad span go."""
    take(params, {"strict": bool})
    value, index = inputs["evidence"], inputs["index"]
    if "evidence" not in value.df.columns:
        return {"evidence": value}
    text = index.type.metadata.get("text_field", "text")
    docs = index.df.select(quoted(_id(index)).cast("string").alias("__id"), quoted(text).alias("__text"))
    joined = value.df.join(docs, F.col("__document").cast("string") == F.col("__id"), "left")
    good = F.forall("evidence", lambda s: (s["document_id"] == F.col("__id")) & (F.substring(F.col("__text"), s["start_char"] + 1, s["end_char"] - s["start_char"]) == s["quoted"]))
    ok = F.coalesce(good, F.lit(False))
    if params["strict"]:
        checked = joined.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("SPAN_INVALID")).cast("boolean")))
    else:
        checked = joined.where(ok)
    return {"evidence": Value(checked.select(value.df.columns), value.type)}


def search_lines(files: DataFrame, text: str, path: str = "path", body: str = "text") -> DataFrame:
    """(path, line, content) of lines that hold text, whatever the case; lines count from 1."""
    lines = files.select(quoted(path).alias("path"), F.posexplode(F.split(F.coalesce(quoted(body), F.lit("")), "\n")).alias("k", "content"))
    return lines.where(F.contains(F.lower("content"), F.lit(text.lower()))).select("path", (F.col("k") + 1).alias("line"), "content")


def read_lines(files: DataFrame, start: int, count: int, path: str = "path", body: str = "text") -> DataFrame:
    """Lines start .. start + count - 1 of each file."""
    lines = F.slice(F.split(F.coalesce(quoted(body), F.lit("")), "\n"), start, count)
    return files.select(quoted(path).alias("path"), F.posexplode(lines).alias("k", "content")).select("path", (F.col("k") + start).alias("line"), "content")


def covered(witnesses: DataFrame, available: DataFrame) -> DataFrame:
    """(fact, covered): a fact is covered if one of its witness sets lies within the available
    units. witnesses (fact, witness, unit); available (unit)."""
    marked = witnesses.join(available.select("unit").distinct().withColumn("__have", F.lit(True)), "unit", "left")
    sets = marked.groupBy("fact", "witness").agg(F.bool_and(F.coalesce("__have", F.lit(False))).alias("whole"))
    return sets.groupBy("fact").agg(F.bool_or("whole").alias("covered"))


def read_probe_inputs(files: DataFrame, wanted: DataFrame, key: str = "path") -> DataFrame:
    """(path, text) of the files that a probe names; a name that is not there gives no row. Files
    are told apart by key: where several have one path, by another column than that."""
    return files.join(wanted.select(quoted(key)).distinct(), key, "left_semi").select("path", "text")
