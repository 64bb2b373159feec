"""Documents, retrieval, chunks and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import documents as D
from loomwork.operators.base import Value
from loomwork.plans.types import Type, scalar
from loomwork.queries.base import op, query, t
from loomwork.sources.registry import document_index, id_set, list_files


def index(spark, sf_dir, name: str = "documents", key: str = "doc_id") -> Value:
    return document_index(t(spark, sf_dir, name).select(F.col(key).alias("id"), "text"))


for _impl in ("batched", "per_document"):
    query(f"q_read_documents_{_impl}", "SELECT doc_id AS id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")(lambda s, d, i=_impl: _read(s, d, i))


def _read(spark, sf_dir, implementation):
    ix = index(spark, sf_dir)
    ids = id_set(t(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")), ix)
    return op("read_documents", implementation, {"index": ix, "ids": ids}, {"fields": ["id", "text"], "batch_size": 8}).df


_TOK = "SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS t FROM documents"
_SCORE = " + ".join(f"idf{i} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / a))" for i in range(2))
_BM25 = f"""
WITH k AS ({_TOK}), f AS (SELECT id, len(t) AS dl, len(list_filter(t, lambda x: x = 'the')) AS f0, len(list_filter(t, lambda x: x = 'of')) AS f1 FROM k),
g AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM f),
s AS (SELECT id, f0, f1, dl, a, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) AS idf0, ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) AS idf1 FROM f, g)
SELECT id, round({_SCORE}, 6) AS score FROM s WHERE f0 + f1 > 0 ORDER BY {_SCORE} DESC, id LIMIT 15"""
query("q_bm25", _BM25)(lambda s, d: op("text_retrieve", "bm25", {"index": index(s, d)}, {"query": "the of", "limit": 15}).df.select("id", F.round("score", 6).alias("score")))


@query("q_dense_topk", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) DESC, vec_id LIMIT 20")
def dense_topk(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    vector = e.where("id = 0").first()["embedding"]
    ix = Value(e, Type("DocumentIndex", schema=(("id", scalar("Int64")),), domain="v", revision="1", metadata={"id_field": "id"}))
    return op("text_retrieve", "dense_fixed", {"index": ix}, {"vector": [float(x) for x in vector], "limit": 20}).df.select("id", F.round("score", 6).alias("score"))


_WORDS = "SELECT doc_id AS id, text, regexp_extract_all(text, '\\S+') AS w FROM documents"


@query("q_split_tokens", f"WITH k AS ({_WORDS}), c AS (SELECT id, w, unnest(range(0, CASE WHEN len(w) <= 12 THEN 1 ELSE CAST(ceil((len(w) - 4) / 8.0) AS BIGINT) END)) AS n FROM k WHERE len(w) > 0) SELECT id, CAST(n AS INTEGER) AS chunk_no, CAST(len(w[n * 8 + 1:n * 8 + 12]) AS INTEGER) AS words, w[n * 8 + 1] AS first FROM c")
def split_tokens(spark, sf_dir):
    chunks = op("split_documents", "token_window", {"documents": index(spark, sf_dir)}, {"size": 12, "overlap": 4}).df
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return chunks.select("id", "chunk_no", F.size(words).alias("words"), F.element_at(words, 1).alias("first"))


query("q_split_sections", "SELECT doc_id AS id, len(regexp_split_to_array(text, '\\n\\s*\\n')) AS sections, length(text) AS n FROM documents WHERE text <> ''")(lambda s, d: _sections(s, d))


def _sections(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("id"), "text")
    chunks = op("split_documents", "section", {"documents": document_index(docs)}, {"size": 1, "overlap": 0}).df
    return chunks.groupBy("id").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.col("end_char") - F.col("start_char")).alias("n"))


@query("q_gather_context", "SELECT conv_id AS id, turn AS chunk_no, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM conversations")
def gather(spark, sf_dir):
    return _gather(spark, sf_dir, "neighbors", 1)


query("q_gather_header", "SELECT conv_id AS id, turn AS chunk_no, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations")(lambda s, d: _gather(s, d, "section_header", 0))


def _gather(spark, sf_dir, implementation, window):
    chunks = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("chunk_no"), "text")
    value = Value(chunks, Type("ChunkStream", schema=(("id", scalar("Int64")), ("text", scalar("Utf8")))))
    return op("gather_context", implementation, {"chunks": value}, {"window": window}).df.select("id", "chunk_no", "context")


def _texts(spark, sf_dir) -> Value:
    """Order lines as text: `status: F priority: 1-URGENT` and so on."""
    o = t(spark, sf_dir, "orders")
    text = F.concat(F.lit("status: "), "o_orderstatus", F.lit(" customer = "), F.col("o_custkey").cast("string"), F.lit(" end"))
    return document_index(o.select(F.col("o_orderkey").alias("id"), text.alias("text")))


def _extracted(spark, sf_dir) -> Value:
    return op("semantic_extract", "fixed_e0", {"documents": _texts(spark, sf_dir)}, {"field_schema": {"status": "utf8", "customer": "int64"}, "context_budget": 64})


query("q_semantic_extract", "SELECT o_orderstatus AS status, o_custkey AS customer FROM orders")(lambda s, d: _extracted(s, d).df.select("status", "customer"))


def _merged(spark, sf_dir, implementation, policy, rule=None):
    v = _extracted(spark, sf_dir)
    params = {"keys": ["customer"], "conflict_policy": policy} | ({"priority_rule": rule} if rule else {})
    return op("evidence_merge", implementation, {"evidence": v}, params).df.select("customer", "status")


query("q_evidence_merge_all", "SELECT o_custkey AS customer, o_orderstatus AS status FROM orders")(lambda s, d: _merged(s, d, "by_entity", "keep_all"))
query("q_evidence_merge_reject", "SELECT o_custkey AS customer, min(o_orderstatus) AS status FROM orders GROUP BY o_custkey HAVING min(o_orderstatus) = max(o_orderstatus)")(lambda s, d: _merged(s, d, "by_document", "reject"))
query("q_evidence_merge_priority", "SELECT o_custkey AS customer, max(o_orderstatus) AS status FROM orders GROUP BY o_custkey")(lambda s, d: _merged(s, d, "by_entity", "declared_priority", {"field": "status", "direction": "desc"}))
query("q_span_check", "SELECT o_custkey AS customer, o_orderstatus AS status FROM orders")(lambda s, d: op("evidence_validate", "span_check", {"evidence": _extracted(s, d), "index": _texts(s, d)}, {"strict": True}).df.select("customer", "status"))


@query("q_span_check_drop", "SELECT count(*) AS n FROM orders WHERE o_orderkey % 2 = 0")
def span_check_drop(spark, sf_dir):
    """Half of the documents change after extraction; their evidence goes."""
    v, ix = _extracted(spark, sf_dir), _texts(spark, sf_dir)
    changed = Value(ix.df.withColumn("text", F.when(F.col("id") % 2 != 0, F.concat(F.lit("x"), "text")).otherwise(F.col("text"))), ix.type)
    return op("evidence_validate", "span_check", {"evidence": v, "index": changed}, {"strict": False}).df.agg(F.count(F.lit(1)).alias("n"))


# --- text search ---------------------------------------------------------------------------------
query("q_search_source", "SELECT url AS path, CAST(n AS INTEGER) AS line, content FROM (SELECT url, unnest(range(1, len(x) + 1)) AS n, unnest(x) AS content FROM (SELECT url, string_split(html, chr(10)) AS x FROM pages)) WHERE contains(lower(content), 'title>the')")(lambda s, d: D.search_lines(t(s, d, "pages"), "Title>The", "url", "html"))
query("q_read_lines", "SELECT CAST(doc_id AS VARCHAR) AS path, CAST(unnest(range(2, 2 + len(x))) AS INTEGER) AS line, unnest(x) AS content FROM (SELECT doc_id, string_split(text, chr(10))[2:4] AS x FROM documents)")(lambda s, d: D.read_lines(t(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), 2, 3))
query("q_list_files", "SELECT url AS path FROM pages WHERE url LIKE 'https://%'")(lambda s, d: list_files(t(s, d, "pages").select(F.col("url").alias("path")), "https://"))


@query("q_coverage", "SELECT o_custkey AS fact, bool_or(w) AS covered FROM (SELECT o_custkey, o_orderkey, bool_and(l_partkey % 2 = 0) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY o_custkey")
def coverage(spark, sf_dir):
    """A customer is covered if all parts of one of their orders are available (even keys)."""
    rows = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    w = rows.select(F.col("o_custkey").alias("fact"), F.col("o_orderkey").alias("witness"), F.col("l_partkey").alias("unit"))
    return D.covered(w, t(spark, sf_dir, "lineitem").where("l_partkey % 2 = 0").select(F.col("l_partkey").alias("unit")))
