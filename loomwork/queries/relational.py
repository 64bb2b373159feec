"""Scans, predicates, joins, aggregates, order, sets, lifecycle and control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import domains
from loomwork.operators.control import repeat_until
from loomwork.operators.relational import last_write_wins, pages_complete
from loomwork.plans.compiler import compile_plan
from loomwork.plans.predicates import call, field, lit
from loomwork.queries.base import op, query, scan, source, t

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def topk_plan(k: int = 20, implementation: str = "streaming_heap") -> dict:
    """The scan, filter, top-k, project, emit chain as a plan."""
    return {
        "ir_version": "1.0", "task_id": "orders-top", "external_inputs": {"records": "dataset:orders:v1"}, "result": "answer.result",
        "nodes": [
            {"id": "read", "operator": "scan", "implementation": "sequential", "inputs": {"source": "$input.records"}, "params": {"columns": ["o_orderkey", "o_totalprice", "o_orderstatus"]}, "outputs": {"rows": "Stream[Record]"}},
            {"id": "keep", "operator": "filter", "implementation": "vectorized", "inputs": {"rows": "read.rows"}, "params": {"predicate": call("eq", field("o_orderstatus"), lit("F"))}, "outputs": {"rows": "Stream[Record]"}},
            {"id": "best", "operator": "top_k", "implementation": implementation, "inputs": {"rows": "keep.rows"}, "params": {"k": k, "keys": [{"field": "o_totalprice", "direction": "desc"}, {"field": "o_orderkey", "direction": "asc"}]}, "outputs": {"rows": "Table"}},
            {"id": "fields", "operator": "project", "implementation": "column_view", "inputs": {"rows": "best.rows"}, "params": {"columns": ["o_orderkey", "o_totalprice"]}, "outputs": {"rows": "Table"}},
            {"id": "answer", "operator": "emit", "implementation": "json_artifact", "inputs": {"rows": "fields.rows"}, "params": {"output_contract": "top_orders"}, "outputs": {"result": "Result"}},
        ],
    }


TOP = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"


@query("q_topk_f1", TOP)
def flagship(spark, sf_dir) -> DataFrame:
    return compile_plan(topk_plan(), {"records": source(spark, sf_dir, "orders")}).result.df.drop("__ord")


@query("q_topk_full_sort", TOP)
def topk_full_sort(spark, sf_dir):
    return compile_plan(topk_plan(implementation="full_sort"), {"records": source(spark, sf_dir, "orders")}).result.df.drop("__ord")


# --- scans and predicates --------------------------------------------------------------------
HIGH = call("ge", field("o_totalprice"), lit(200000.0))
query("q_scan_pred", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 200000")(lambda s, d: scan(s, d, "orders", ["o_orderkey", "o_custkey"], HIGH).visible())
query("q_scan_index_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey <= 500")(lambda s, d: scan(s, d, "orders", ["o_orderkey", "o_totalprice"], call("le", field("o_orderkey"), lit(500)), "index_range").visible())
for _impl in ("column_view", "copy"):
    query(f"q_project_{_impl}", "SELECT o_orderkey, o_orderstatus FROM orders")(lambda s, d, i=_impl: op("project", i, {"rows": scan(s, d, "orders", ORDERS)}, {"columns": ["o_orderkey", "o_orderstatus"]}).visible())

#: 3-valued logic needs nulls: o_custkey is null on the outer side of this join.
THREE = call("or", call("and", call("gt", field("amount"), lit(1000.0)), call("not", call("is_null", field("o_custkey")))), call("eq", field("o_orderstatus"), lit("P")))


def _with_nulls(spark, sf_dir):
    from loomwork.sources.registry import Registry

    df = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("c_acctbal").alias("amount"), "o_orderkey", "o_custkey", "o_orderstatus")
    return op("scan", "sequential", {"source": Registry(spark).add("x", df, ["c_custkey", "o_orderkey"])}, {"columns": df.columns})


JOINED = "SELECT c_custkey, c_acctbal AS amount, o_orderkey, o_custkey, o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey"
for _impl in ("scalar", "vectorized"):
    query(f"q_filter_3vl_{_impl}", f"SELECT * FROM ({JOINED}) WHERE (amount > 1000 AND NOT o_custkey IS NULL) OR o_orderstatus = 'P'")(lambda s, d, i=_impl: op("filter", i, {"rows": _with_nulls(s, d)}, {"predicate": THREE}).visible())
query("q_filter_not", f"SELECT * FROM ({JOINED}) WHERE NOT (o_orderstatus = 'F')")(lambda s, d: op("filter", "scalar", {"rows": _with_nulls(s, d)}, {"predicate": call("not", call("eq", field("o_orderstatus"), lit("F")))}).visible())
query("q_filter_in", f"SELECT * FROM ({JOINED}) WHERE o_orderstatus IN ('F', 'P', NULL)")(lambda s, d: op("filter", "scalar", {"rows": _with_nulls(s, d)}, {"predicate": call("in", field("o_orderstatus"), lit(["F", "P", None]))}).visible())
query("q_filter_in_empty", f"SELECT * FROM ({JOINED}) WHERE NOT false")(lambda s, d: op("filter", "scalar", {"rows": _with_nulls(s, d)}, {"predicate": call("not", call("in", field("o_custkey"), lit([])))}).visible())
query("q_filter_temporal", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'")(lambda s, d: scan(s, d, "orders", ["o_orderkey"], call("ge", field("o_orderdate"), lit("1996-01-01T00:00:00Z"))).visible())
query("q_arith_guarded", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) / l_quantity > 1500")(
    lambda s, d: scan(s, d, "lineitem", ["l_orderkey", "l_linenumber"], call("gt", call("div", call("mul", field("l_extendedprice"), call("sub", lit(1.0), field("l_discount"))), field("l_quantity")), lit(1500.0))).visible().withColumn("l_linenumber", F.col("l_linenumber").cast("int"))
)

# --- joins -----------------------------------------------------------------------------------
CUSTOMER, NATION = ["c_custkey", "c_nationkey", "c_acctbal"], ["n_nationkey", "n_name"]


def _joined(spark, sf_dir, how: str, implementation: str, build: str | None = None):
    left = scan(spark, sf_dir, "customer", CUSTOMER, call("gt", field("c_acctbal"), lit(0.0)))
    right = scan(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"], call("gt", field("o_totalprice"), lit(100000.0)))
    params = {"keys": [{"left": "c_custkey", "right": "o_custkey"}], "join_type": how} | ({"build_side": build} if build else {})
    return op("join", implementation, {"left": left, "right": right}, params).df


_SIDES = "(SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 0) c {how} JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000) o ON c_custkey = o_custkey"
for _how in ("inner", "left", "right", "full", "semi", "anti"):
    query(f"q_join_{_how}", f"SELECT * FROM {_SIDES.format(how=_how)}")(lambda s, d, h=_how: _joined(s, d, h, "sort_merge"))
for _impl in ("hash", "sort_merge", "block_nested"):
    query(f"q_join_impl_{_impl}", f"SELECT * FROM {_SIDES.format(how='inner')}")(lambda s, d, i=_impl: _joined(s, d, "inner", i, "right" if i == "hash" else None))


@query("q_join_prefix", "SELECT a.n_nationkey AS \"left.n_nationkey\", a.n_name AS \"left.n_name\", b.n_nationkey AS \"right.n_nationkey\", b.n_name AS \"right.n_name\" FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey")
def join_prefix(spark, sf_dir):
    n = scan(spark, sf_dir, "nation", NATION)
    df = op("join", "hash", {"left": n, "right": scan(spark, sf_dir, "nation", NATION)}, {"keys": [{"left": "n_nationkey", "right": "n_nationkey"}], "join_type": "inner", "build_side": "left"}).df
    return df.select(*[F.col(f"`{c}`").cast("int").alias(c) if c.endswith("key") else F.col(f"`{c}`") for c in df.columns])


# --- aggregates ------------------------------------------------------------------------------
_AGG = [{"function": "count", "as": "n"}, {"function": "min", "field": "o_totalprice", "as": "lo"}, {"function": "max", "field": "o_totalprice", "as": "hi"}, {"function": "sum", "field": "o_custkey", "as": "s"}]
for _impl in ("hash_group", "sorted_group"):
    query(f"q_agg_{_impl}", "SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")(lambda s, d, i=_impl: op("aggregate", i, {"rows": scan(s, d, "orders", ORDERS)}, {"group_by": ["o_orderstatus"], "aggregates": _AGG}).df)
query("q_agg_global", "SELECT count(*) AS n, round(avg(o_custkey), 6) AS m FROM orders")(lambda s, d: op("aggregate", "hash_group", {"rows": scan(s, d, "orders", ORDERS)}, {"aggregates": [{"function": "count", "as": "n"}, {"function": "mean", "field": "o_custkey", "as": "m"}]}).df.select("n", F.round("m", 6).alias("m")))
query("q_agg_count_null", f"SELECT c_custkey, count(o_custkey) AS n FROM ({JOINED}) GROUP BY c_custkey")(lambda s, d: op("aggregate", "hash_group", {"rows": _with_nulls(s, d)}, {"group_by": ["c_custkey"], "aggregates": [{"function": "count", "field": "o_custkey", "as": "n"}]}).df)


@query("q_f2_region_totals", "SELECT n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def region_totals(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    per = o.groupBy("o_custkey").agg(F.sum(domains.money(F.col("o_totalprice"))).alias("s"))  # before the joins
    c, n = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), t(spark, sf_dir, "nation")
    rows = per.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("s").alias("s"))
    return rows.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("s").cast("double").alias("total"))


# --- order, duplicates, sets -----------------------------------------------------------------
for _impl in ("in_memory", "external_merge"):
    query(f"q_sort_{_impl}", f"SELECT * FROM ({JOINED}) ORDER BY o_orderkey DESC NULLS FIRST, c_custkey")(lambda s, d, i=_impl: op("sort", i, {"rows": _with_nulls(s, d)}, {"keys": [{"field": "o_orderkey", "direction": "desc", "nulls": "first"}, {"field": "c_custkey"}]}).visible())
for _keep, _order in (("first", ""), ("last", " DESC")):
    for _impl in ("hash", "sort_unique"):
        query(f"q_dedup_{_keep}_{_impl}", f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey{_order}) AS n FROM orders) WHERE n = 1")(lambda s, d, k=_keep, i=_impl: op("deduplicate", i, {"rows": scan(s, d, "orders", ORDERS)}, {"keys": ["o_custkey"], "keep": k}).visible())


def _sets(spark, sf_dir):
    from loomwork.sources.registry import id_set

    a = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    b = t(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id"))
    return {"left": id_set(a, kind="Set"), "right": id_set(b, kind="Set")}


_A, _B = "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'O'"
for _mode, _word in (("union", "UNION"), ("intersection", "INTERSECT"), ("difference", "EXCEPT")):
    for _impl in ("hash", "sorted_merge"):
        query(f"q_set_{_mode}_{_impl}", f"{_A} {_word} {_B}")(lambda s, d, m=_mode, i=_impl: op("set_op", i, _sets(s, d), {"mode": m}).df)

query("q_last_write", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")(lambda s, d: last_write_wins(t(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey"))
query("q_page", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")(lambda s, d: t(s, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(200).limit(100))


@query("q_page_completeness", "SELECT o_custkey, count(*) > 10 AS complete FROM orders GROUP BY o_custkey")
def page_completeness(spark, sf_dir):
    """Pages of two rows for each customer; those of up to ten orders lack their last page."""
    n = t(spark, sf_dir, "orders").groupBy("o_custkey").count()
    pages = n.select("o_custkey", "count", F.explode(F.sequence(F.lit(0), F.ceil(F.col("count") / 2.0).cast("int") - 1)).alias("k"))
    pages = pages.select("o_custkey", (F.col("k") * 2).alias("offset"), F.lit(2).alias("n"), ((F.col("k") * 2 + 2 < F.col("count")) | (F.col("count") <= 10)).alias("has_more"))
    return pages_complete(pages, "o_custkey")


# --- lifecycle -------------------------------------------------------------------------------
_PLAIN = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000"


def _high(s, d):
    return scan(s, d, "orders", ["o_orderkey", "o_totalprice"], HIGH)


for _impl in ("memory", "disk"):
    query(f"q_materialize_{_impl}", _PLAIN)(lambda s, d, i=_impl: op("materialize", i, {"rows": _high(s, d)}, {"format": "parquet"}).visible())
    query(f"q_cache_{_impl}", _PLAIN)(lambda s, d, i=_impl: op("cache", i, {"artifact": _high(s, d)}, {"key_fields": ["o_orderkey"]}).df.drop("__ord"))
for _impl in ("shared_ref", "copy_each"):
    query(f"q_broadcast_{_impl}", f"{_PLAIN} UNION ALL {_PLAIN}")(lambda s, d, i=_impl: _two(s, d, i))


def _two(spark, sf_dir, implementation):
    from loomwork.operators.base import REGISTRY

    out = REGISTRY["broadcast", implementation]({"artifact": _high(spark, sf_dir)}, {"consumers": ["one", "two"]})
    return out["one"].df.drop("__ord").unionByName(out["two"].df.drop("__ord"))


query("q_stream_read", _PLAIN)(lambda s, d: op("stream_read", "arrow_batches", {"artifact": _high(s, d)}, {"batch_size": 64}).visible())
query("q_collect_guard", "SELECT r_regionkey, r_name FROM region")(lambda s, d: op("collect", "bounded_collect", {"rows": scan(s, d, "region", ["r_regionkey", "r_name"])}, {"limit": 10}).visible().withColumn("r_regionkey", F.col("r_regionkey").cast("int")))
query("q_emit", _PLAIN)(lambda s, d: op("emit", "json_artifact", {"rows": _high(s, d)}, {"output_contract": "high_orders"}).df.drop("__ord"))


@query("q_release", _PLAIN)
def release(spark, sf_dir):
    held = op("cache", "memory", {"artifact": _high(spark, sf_dir)}, {"key_fields": ["o_orderkey"]})
    op("release", "explicit", {"artifact": held}, {})
    return held.df.drop("__ord")


query("q_stats_metadata", "SELECT count(*) AS rows, count(*) FILTER (o_totalprice IS NULL) AS o_totalprice_nulls, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max FROM orders")(lambda s, d: op("stats", "metadata", {"source": source(s, d, "orders")}, {"fields": ["o_totalprice"]}).df)
_SAMPLED = "SELECT o_totalprice FROM orders ORDER BY md5('{\"__ord\":{\"o_orderkey\":' || o_orderkey || '}}'), o_orderkey LIMIT 100"
query("q_stats_sample", f"SELECT count(*) AS rows, count(*) FILTER (o_totalprice IS NULL) AS o_totalprice_nulls, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max FROM ({_SAMPLED})")(lambda s, d: op("stats", "sample", {"source": source(s, d, "orders")}, {"fields": ["o_totalprice"], "sample_size": 100}).df)

# --- control ---------------------------------------------------------------------------------
_REGION_ID = {"bindings": {"item": "$item"}, "nodes": [{"id": "cut", "operator": "project", "implementation": "column_view", "inputs": {"rows": "$bound.item"}, "params": {"columns": ["r_name"]}, "outputs": {"rows": "Stream"}}], "yield": {"rows": "cut.rows"}}


def _control(spark, sf_dir, nodes: list[dict], result: str, inputs: dict):
    plan = {"ir_version": "1.0", "task_id": "control", "external_inputs": {k: k for k in inputs}, "nodes": nodes, "result": result}
    return compile_plan(plan, inputs).result


@query("q_map_bounded", "SELECT r_name FROM region")
def map_bounded(spark, sf_dir):
    nodes = [
        {"id": "read", "operator": "scan", "implementation": "sequential", "inputs": {"source": "$input.region"}, "params": {"columns": ["r_regionkey", "r_name"]}, "outputs": {"rows": "Stream[Record]"}},
        {"id": "each", "operator": "map", "implementation": "bounded_map", "inputs": {"rows": "read.rows"}, "params": {}, "outputs": {"rows": "Stream[Record]"}, "regions": {"body": _REGION_ID}},
    ]
    return _control(spark, sf_dir, nodes, "each.rows", {"region": source(spark, sf_dir, "region")}).visible()


@query("q_branch", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def branch(spark, sf_dir):
    """The region count decides between two filters."""
    count = op("aggregate", "hash_group", {"rows": scan(spark, sf_dir, "region", ["r_regionkey"])}, {"aggregates": [{"function": "count", "as": "n"}]})
    nation = scan(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    arm = lambda key: {"bindings": {"rows": "$input.nation"}, "nodes": [{"id": "f", "operator": "filter", "implementation": "scalar", "inputs": {"rows": "$bound.rows"}, "params": {"predicate": call("eq", field("n_regionkey"), lit(key))}, "outputs": {"rows": "Stream"}}], "yield": {"rows": "f.rows"}}
    nodes = [{"id": "pick", "operator": "branch", "implementation": "predicate_branch", "inputs": {"state": "$input.count"}, "params": {"predicate": call("gt", field("n"), lit(3))}, "outputs": {"rows": "Stream"}, "regions": {"then": arm(1), "else": arm(2)}}]
    return _control(spark, sf_dir, nodes, "pick.rows", {"count": count, "nation": nation}).visible().select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("q_loop_countdown", "SELECT CAST(3 AS BIGINT) AS remaining")
def loop_countdown(spark, sf_dir):
    """Halve while above four: 25 nations give 25, 12, 6, 3."""
    start = t(spark, sf_dir, "nation").agg(F.count(F.lit(1)).alias("remaining"))
    from loomwork.sources.storage import store

    holds = lambda df: df.select(F.col("remaining") > 4).first()[0]
    return repeat_until(start, holds, lambda df: store(df.select(F.floor(F.col("remaining") / 2).alias("remaining")), "state"), 16)


# --- domain summaries ------------------------------------------------------------------------
query("q_customer_summary", "SELECT o_custkey, count(*) AS n, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,4))), 2) AS DOUBLE) AS total FROM orders WHERE CAST(o_orderdate AS VARCHAR) LIKE '1996%' GROUP BY o_custkey")(lambda s, d: domains.customer_summary(t(s, d, "orders"), "o_custkey", "o_totalprice", "o_orderdate", "1996"))


@query("q_loan_summary", "SELECT r_name AS region, count(*) AS n, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,4))), 2) AS DOUBLE) AS total, CAST(round(sum(CASE WHEN o_orderstatus IN ('P') THEN CAST(o_totalprice AS DECIMAL(18,4)) ELSE 0 END), 2) AS DOUBLE) AS adverse FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def loan_summary(spark, sf_dir):
    loans = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account_id"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderstatus") == "P", "B").otherwise("A").alias("status"))
    accounts = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_nationkey").alias("district_id"))
    districts = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("district_id"), F.col("r_name").alias("region"))
    return domains.loan_summary(loans, accounts, districts)


@query("q_purchase_summary", "SELECT o_custkey AS customer, count(DISTINCT o_orderkey) AS orders, sum(l_quantity) AS quantity, CAST(round(sum(CAST(l_extendedprice * l_quantity * (1 - l_discount) AS DECIMAL(18,4))), 2) AS DOUBLE) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def purchase_summary(spark, sf_dir):
    headers = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"))
    lines = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return domains.purchase_summary(headers, lines)


@query("q_playlist_summary", "SELECT l_orderkey AS playlist, count(*) AS songs, sum(l_quantity) AS duration FROM lineitem GROUP BY l_orderkey")
def playlist_summary(spark, sf_dir):
    songs = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("playlist"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("duration"))
    return domains.playlist_summary(songs)


@query("q_choose_playlist", "SELECT l_orderkey AS playlist, count(*) AS songs, sum(l_quantity) AS duration FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) >= 100 ORDER BY duration, playlist LIMIT 1")
def choose_playlist(spark, sf_dir):
    return domains.choose_playlist(playlist_summary(spark, sf_dir), 100)


@query("q_partial_merge", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
def partial_merge(spark, sf_dir):
    parts = t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s"))
    return domains.merge_partials(parts, ["l_returnflag"], ["n", "s"])


query("q_policy_class", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'unsupported' WHEN c_acctbal >= 1000 THEN 'high' ELSE 'low' END AS class FROM customer")(lambda s, d: t(s, d, "customer").select("c_custkey", domains.policy_class(F.col("c_acctbal"), F.when(F.col("c_mktsegment") != "BUILDING", F.lit(1000.0))).alias("class")))

# --- telemetry -------------------------------------------------------------------------------
CUT = "2024-01-15 00:00:00"


@query("q_metric_summary", f"SELECT event_type AS metric, round(avg(value) FILTER (ts < TIMESTAMP '{CUT}'), 6) AS pre, round(avg(value) FILTER (ts >= TIMESTAMP '{CUT}'), 6) AS post, round(avg(value) FILTER (ts >= TIMESTAMP '{CUT}') / avg(value) FILTER (ts < TIMESTAMP '{CUT}'), 6) AS ratio FROM events GROUP BY event_type")
def metric_summary(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("metric"), "value")
    out = domains.metric_summary(rows, F.to_timestamp(F.lit(CUT)))
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("pre", "post", "ratio")])


@query("q_trace_summary", f"SELECT event_type AS service, round(median(value) FILTER (ts < TIMESTAMP '{CUT}'), 6) AS pre, round(median(value) FILTER (ts >= TIMESTAMP '{CUT}'), 6) AS post, count(*) AS n FROM events GROUP BY event_type")
def trace_summary(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("start_ms"), F.col("event_type").alias("service"), F.col("value").alias("duration"))
    out = domains.trace_summary(rows, F.unix_millis(F.to_timestamp(F.lit(CUT))))
    return out.select("service", F.round("pre", 6).alias("pre"), F.round("post", 6).alias("post"), "n")


query("q_wide_metrics", "SELECT CAST(o_orderkey AS BIGINT) AS time, 'o_totalprice' AS metric, o_totalprice AS value FROM orders")(lambda s, d: domains.wide_metrics(t(s, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), "o_orderkey", contains="price"))
query("q_log_search", "SELECT role AS service, count(*) AS n FROM conversations WHERE regexp_matches(text, '(?i)th[ae]') GROUP BY role")(lambda s, d: domains.log_search(t(s, d, "conversations"), "th[ae]", "role", "text").withColumnRenamed("role", "service"))


@query("q_trace_relations", "SELECT p.role AS parent, c.role AS service, 'turn' AS operation, count(*) AS n FROM conversations c LEFT JOIN conversations p ON c.conv_id = p.conv_id AND c.turn - 1 = p.turn GROUP BY ALL")
def trace_relations(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("span_id"), (F.col("turn") - 1).alias("parent_id"), F.col("role").alias("service"), F.lit("turn").alias("operation"))
    return domains.trace_relations(c)


query("q_service_catalog", "SELECT DISTINCT event_type FROM events")(lambda s, d: domains.service_catalog(t(s, d, "events"), "event_type"))

# --- checks and business state ---------------------------------------------------------------
@query("q_run_checks", "SELECT d.doc_id AS check_id, 0 AS case_id, l.quality AS observed, 1 AS expected, coalesce(l.quality = 1, false) AS passed FROM documents d LEFT JOIN labels l USING (doc_id)")
def run_checks(spark, sf_dir):
    observed = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("check_id"), F.lit(0).alias("case_id"), F.col("quality").alias("observed"))
    contracts = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("check_id"), F.lit(0).alias("case_id"), F.lit(1).alias("expected"))
    return domains.run_checks(observed, contracts)


@query("q_state_download", "SELECT DISTINCT l_partkey AS song FROM lineitem")
def state_download(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("song"), "l_orderkey")
    return domains.download(rows.where("l_orderkey % 2 = 0").select("song").distinct(), rows.where("l_orderkey % 2 <> 0").select("song"))[0]


@query("q_state_payment", "SELECT c_custkey AS member, coalesce(amount, c_acctbal) AS amount FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS amount FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def state_payment(spark, sf_dir):
    ledger = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("member"), F.col("c_acctbal").alias("amount"))
    return domains.request_payments(ledger, t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("member"), F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("seq")))


@query("q_payment_gaps", "SELECT c_custkey AS id, 500000 - CAST(floor(c_acctbal * 100) AS BIGINT) AS due FROM customer WHERE floor(c_acctbal * 100) < 500000")
def payment_gaps(spark, sf_dir):
    return domains.payment_gaps(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(500000).cast("long").alias("share_cents"), F.floor(F.col("c_acctbal") * 100).alias("paid_cents")))


@query("q_state_contract", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'changed' WHEN o_orderkey % 10 = 2 THEN 'missing' ELSE 'unexpected' END AS difference FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 IN (1, 2) UNION ALL SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey % 50 = 0)")
def state_contract(spark, sf_dir):
    from loomwork.functions.compare import state_difference

    expected = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    actual = expected.where(k % 10 != 2).withColumn("o_totalprice", F.when(k % 10 == 1, F.lit(-1.0)).otherwise(F.col("o_totalprice")))
    extra = expected.where(k % 50 == 0).withColumn("o_orderkey", -k - 1)
    return state_difference(expected, actual.unionByName(extra), ["o_orderkey"])


# --- SQL surface -----------------------------------------------------------------------------
_SQL = "WITH f AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_mktsegment, max(n) AS most FROM f JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"


def _views(spark, sf_dir):
    for name in ("orders", "customer"):
        t(spark, sf_dir, name).createOrReplaceTempView(name)
    return ["orders", "customer"]


@query("q_sql_select", _SQL)
def sql_select(spark, sf_dir):
    from loomwork.sources.sql_surface import guard

    return guard(spark, _SQL, _views(spark, sf_dir))


@query("q_sql_explain", "SELECT * FROM (VALUES ('customer', 'c_custkey,c_mktsegment'), ('orders', 'o_custkey')) v(\"table\", columns)")
def sql_explain(spark, sf_dir):
    """What the plan of a query reads: each table's scan with its pruned columns."""
    import re

    from loomwork.sources.sql_surface import explain

    text = explain(spark, _SQL, _views(spark, sf_dir))
    scans = re.findall(r"Location:.*?/(\w+)\.parquet.*?ReadSchema: struct<([^>]*)>", text, re.S)
    rows = {(name, ",".join(c.split(":")[0] for c in schema.split(","))) for name, schema in scans}
    return spark.createDataFrame(sorted(rows), "table string, columns string")


@query("q_row_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
def row_lookup_(spark, sf_dir):
    from loomwork.sources.sql_surface import row_lookup

    _views(spark, sf_dir)
    return row_lookup(spark, "customer", "c_custkey", 42)


@query("q_schema", "SELECT 'customer' AS \"table\", CAST(column_index AS INTEGER) AS position, column_name AS name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS type FROM (SELECT row_number() OVER () - 1 AS column_index, column_name, column_type AS data_type FROM (DESCRIBE SELECT * FROM customer))")
def schema(spark, sf_dir):
    from loomwork.sources.registry import column_facts

    _views(spark, sf_dir)
    return column_facts(spark, ["customer"])
