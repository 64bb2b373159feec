"""Traces, work, comparisons, ledgers, metrics. Runs and events are derived from the events, orders
and line item tables by fixed rules, written out in each query's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import compare as C
from loomwork.functions import metrics as M
from loomwork.functions import traces as T
from loomwork.queries.base import query, t

#: Spans: an event lasts from its second to that plus 40 + id % 7 * 60 seconds, of kind model or tool.
SPANS = "SELECT user_id % 50 AS u, CASE WHEN event_id % 2 = 0 THEN 'model' ELSE 'tool' END AS kind, CAST(floor(epoch(ts) / 900) AS DOUBLE) AS \"start\", CAST(floor(epoch(ts) / 900) + 1 + event_id % 7 AS DOUBLE) AS \"end\" FROM events"


def spans(spark, sf_dir):
    start = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 900).cast("double")
    return t(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("u"), F.when(F.col("event_id") % 2 == 0, "model").otherwise("tool").alias("kind"), start.alias("start"), (start + 1 + F.col("event_id") % 7).alias("end"))


def _union_sql(where: str = "true") -> str:
    """Seconds covered, counted one by one: starts and ends are whole numbers."""
    return f"SELECT u, CAST(count(DISTINCT s) AS DOUBLE) AS seconds FROM (SELECT u, unnest(range(CAST(\"start\" AS BIGINT), CAST(\"end\" AS BIGINT))) AS s FROM ({SPANS}) WHERE {where}) GROUP BY u"


query("q_interval_union", _union_sql())(lambda s, d: T.interval_union(spans(s, d), ["u"]))
query("q_overlap", f"SELECT x.u, x.seconds AS active, coalesce(a.seconds, 0) AS a, coalesce(b.seconds, 0) AS b, coalesce(a.seconds, 0) + coalesce(b.seconds, 0) - x.seconds AS overlap FROM ({_union_sql()}) x LEFT JOIN ({_union_sql(chr(39).join(['kind = ', 'model', '']))}) a USING (u) LEFT JOIN ({_union_sql(chr(39).join(['kind = ', 'tool', '']))}) b USING (u)")(lambda s, d: T.overlap(spans(s, d), ["u"]))


@query("q_span_pairing", "WITH e AS (SELECT user_id AS task_id, event_id AS t, CASE event_id % 3 WHEN 0 THEN 'worker_started' WHEN 1 THEN 'worker_finished' ELSE 'worker_failed' END AS kind FROM events), n AS (SELECT *, lead(t) OVER w AS nt, lead(kind) OVER w AS nk FROM e WINDOW w AS (PARTITION BY task_id ORDER BY t)) SELECT task_id, t AS \"start\", CASE WHEN nk <> 'worker_started' THEN nt END AS \"end\", CASE WHEN nk <> 'worker_started' THEN nk END AS outcome FROM n WHERE kind = 'worker_started'")
def span_pairing(spark, sf_dir):
    k = F.col("event_id") % 3
    kind = F.when(k == 0, "worker_started").when(k == 1, "worker_finished").otherwise("worker_failed")
    return T.pair_spans(t(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("t"), kind.alias("kind")))


_BUF = "SELECT l_suppkey % 20 AS g, CAST(l_quantity AS BIGINT) AS bytes, l_orderkey AS created, CASE WHEN l_linenumber <> 3 THEN l_orderkey + l_linenumber * 5 END AS released FROM lineitem"


@query("q_live_buffers", f"WITH b AS ({_BUF}), m AS (SELECT g, created AS t, bytes AS d FROM b UNION ALL SELECT g, released, -bytes FROM b WHERE released IS NOT NULL), s AS (SELECT g, t, sum(d) AS d FROM m GROUP BY g, t), r AS (SELECT g, t, d, sum(d) OVER (PARTITION BY g ORDER BY t) AS live, lead(t) OVER (PARTITION BY g ORDER BY t) - t AS dt FROM s) SELECT g, CAST(greatest(max(live), 0) AS BIGINT) AS peak, CAST(sum(live * coalesce(dt, 0)) AS BIGINT) AS byte_time, CAST(sum(d) AS BIGINT) AS unreleased FROM r GROUP BY g")
def live_buffers(spark, sf_dir):
    released = F.when(F.col("l_linenumber") != 3, F.col("l_orderkey") + F.col("l_linenumber") * 5)
    rows = t(spark, sf_dir, "lineitem")
    return T.live_buffers(rows.select((F.col("l_suppkey") % 20).alias("g"), F.col("l_quantity").cast("long").alias("bytes"), F.col("l_orderkey").alias("created"), released.alias("released")), ["g"])


@query("q_byte_totals", "SELECT event_type, CASE WHEN count(*) FILTER (event_id % 11 = 0) = 0 THEN CAST(sum(user_id) AS BIGINT) END AS payload, CAST(coalesce(sum(user_id) FILTER (event_id % 11 <> 0), 0) AS BIGINT) AS payload_known, count(*) FILTER (event_id % 11 = 0) AS payload_missing FROM events GROUP BY event_type")
def byte_totals(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("payload"))
    return T.byte_totals(rows, ["event_type"], ["payload"])


# --- work ----------------------------------------------------------------------------------------
@query("q_work_vector", "SELECT u, unit, CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS work FROM (SELECT user_id AS u, 'calls' AS unit, 1.0 AS amount, event_id FROM events UNION ALL SELECT user_id, 'value', floor(value), event_id FROM events) WHERE event_id % 5 <> 0 GROUP BY u, unit")
def work_vector(spark, sf_dir):
    delta = F.create_map(F.lit("calls"), F.lit(1.0), F.lit("value"), F.floor("value").cast("double"))
    return T.work_vector(t(spark, sf_dir, "events").select(F.col("user_id").alias("u"), (F.col("event_id") % 5 == 0).alias("inherited"), delta.alias("resource_delta")), ["u"])


#: Runs: each customer is a cell, each order status a model; work in two units, time, validity.
RUNS = "SELECT o_custkey AS cell, o_orderstatus AS model, CAST(count(*) AS BIGINT) AS w1, CAST(max(o_orderkey) % 5 AS BIGINT) AS w2, CAST(min(o_orderkey) % 9 + 1 AS DOUBLE) AS secs, max(o_orderkey) % 4 <> 0 AS valid FROM orders GROUP BY o_custkey, o_orderstatus"


def runs(spark, sf_dir):
    o = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cell"), F.col("o_orderstatus").alias("model"))
    k = F.max("o_orderkey")
    return o.agg(F.count(F.lit(1)).alias("w1"), (k % 5).alias("w2"), (F.min("o_orderkey") % 9 + 1).cast("double").alias("secs"), (k % 4 != 0).alias("valid"))


_PAIRS = f"WITH r AS ({RUNS}), p AS (SELECT a.cell, a.model AS model_a, b.model AS model_b, a.w1 AS a1, b.w1 AS b1, a.w2 AS a2, b.w2 AS b2, a.secs AS sa, b.secs AS sb FROM r a JOIN r b ON a.cell = b.cell AND a.model < b.model WHERE a.valid AND b.valid)"


def pairs(spark, sf_dir):
    return T.run_pairs(runs(spark, sf_dir).where("valid"), ["cell"])


@query("q_work_relation", f"{_PAIRS} SELECT cell, model_a, model_b, CASE WHEN a1 = b1 AND a2 = b2 THEN 'equal' WHEN a1 <= b1 AND a2 <= b2 THEN 'a_dominates' WHEN a1 >= b1 AND a2 >= b2 THEN 'b_dominates' ELSE 'tradeoff' END AS relation FROM p")
def work_relation(spark, sf_dir):
    units = F.explode(F.array(F.struct(F.col("w1_a").alias("work_a"), F.col("w1_b").alias("work_b")), F.struct(F.col("w2_a").alias("work_a"), F.col("w2_b").alias("work_b")))).alias("x")
    rows = pairs(spark, sf_dir).select("cell", "model_a", "model_b", units).select("cell", "model_a", "model_b", "x.*")
    return T.relation(rows, ["cell", "model_a", "model_b"])


query("q_pair_pool", f"SELECT cell, count(*) AS n, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs FROM ({RUNS}) WHERE valid GROUP BY cell")(lambda s, d: runs(s, d).where("valid").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("pairs", F.floor(F.col("n") * (F.col("n") - 1) / 2)))
query("q_equal_calls", f"{_PAIRS} SELECT model_a, model_b, count(*) AS n FROM p WHERE a1 = b1 AND a2 <> b2 GROUP BY ALL")(lambda s, d: pairs(s, d).where("w1_a = w1_b and w2_a <> w2_b").groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("n")))
_SAVE = "SELECT *, 1 - least(a1, b1) / greatest(a1, b1) AS ws, 1 - CASE WHEN a1 <= b1 THEN sa / sb ELSE sb / sa END AS tsv FROM p WHERE a1 <> b1"


def _savings(spark, sf_dir):
    p = pairs(spark, sf_dir).where("w1_a <> w1_b").withColumnsRenamed({"w1_a": "work_a", "w1_b": "work_b", "secs_a": "time_a", "secs_b": "time_b"})
    return T.savings(p)


query("q_savings", f"{_PAIRS}, z AS ({_SAVE}) SELECT cell, model_a, model_b, round(ws, 6) AS work_saving, round(tsv, 6) AS time_saving, round(ws - tsv, 6) AS gap, CASE WHEN tsv <= 0 THEN 'none' WHEN tsv < ws THEN 'attenuated' ELSE 'proportional' END AS outcome FROM z")(lambda s, d: _savings(s, d).select("cell", "model_a", "model_b", *[F.round(c, 6).alias(c) for c in ("work_saving", "time_saving", "gap")], "outcome"))
query("q_outcome_counts", f"{_PAIRS}, z AS ({_SAVE}) SELECT count(*) FILTER (tsv <= 0) AS none, count(*) FILTER (tsv > 0 AND tsv < ws) AS attenuated, count(*) FILTER (tsv > 0 AND tsv >= ws) AS proportional FROM z")(lambda s, d: _savings(s, d).groupBy().pivot("outcome", ["none", "attenuated", "proportional"]).count())
query("q_parent_mean", f"SELECT model, round(avg(m), 6) AS mean, count(*) AS parents FROM (SELECT model, cell % 7 AS parent, avg(secs) AS m FROM ({RUNS}) GROUP BY ALL) GROUP BY model")(lambda s, d: T.parent_mean(runs(s, d).withColumn("parent", F.col("cell") % 7), ["model"], "parent", "secs").withColumn("mean", F.round("mean", 6)))
query("q_leave_one_out", f"WITH p AS (SELECT model, cell % 7 AS c, sum(secs) AS s, count(*) AS n FROM ({RUNS}) GROUP BY ALL) SELECT model, c AS left_out, round((sum(s) OVER w - s) / (sum(n) OVER w - n), 6) AS mean FROM p WINDOW w AS (PARTITION BY model)")(lambda s, d: T.leave_one_out(runs(s, d).withColumn("c", F.col("cell") % 7), ["model"], "c", "secs").withColumn("mean", F.round("mean", 6)))
_HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def _interval_sql(means: str, draws: int, group: str = "model") -> str:
    """The percentile interval of means (group, parent, m), drawn as T.bootstrap draws."""
    pick = _HASH.format("'1:' || b || ':' || s")
    return f"WITH m AS ({means}), k AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY parent) - 1 AS i, count(*) OVER (PARTITION BY {group}) AS n FROM m), p AS (SELECT {group}, b, {pick} % n AS i FROM (SELECT {group}, n, b, unnest(range(n)) AS s FROM (SELECT DISTINCT {group}, n FROM k), range(1, {draws + 1}) r(b))), x AS (SELECT p.{group}, b, avg(m) AS x FROM p JOIN k ON p.{group} = k.{group} AND p.i = k.i GROUP BY ALL) SELECT x.{group}, round(any_value(y.mean), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM x JOIN (SELECT {group}, avg(m) AS mean FROM m GROUP BY {group}) y USING ({group}) GROUP BY x.{group}"


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c in ("mean", "low", "high") else c for c in df.columns])


query("q_bootstrap", _interval_sql(f"SELECT model, cell % 97 AS parent, avg(secs) AS m FROM ({RUNS}) GROUP BY ALL", 4000))(lambda s, d: _rounded(T.bootstrap(runs(s, d).withColumn("parent", F.col("cell") % 97), ["model"], "parent", "secs", draws=4000)))
_CLUSTERED = f"""
WITH m AS (SELECT model, cell % 97 % 7 AS q, cell % 97 AS parent, avg(secs) AS m FROM ({RUNS}) GROUP BY ALL),
g AS (SELECT model, q, count(*) AS n, row_number() OVER (PARTITION BY model ORDER BY q) - 1 AS c, count(*) OVER (PARTITION BY model) AS k FROM m GROUP BY model, q),
o AS (SELECT model, c, n, m, row_number() OVER (PARTITION BY model, c ORDER BY parent) - 1 AS i FROM m JOIN g USING (model, q)),
p AS (SELECT model, b, j, {_HASH.format("'1:c:' || b || ':' || j")} % k AS c FROM (SELECT model, k, b, unnest(range(k)) AS j FROM (SELECT DISTINCT model, k FROM g), range(1, 2001) r(b))),
s AS (SELECT model, b, c, {_HASH.format("'1:' || b || ':' || j || ':' || s")} % n AS i FROM (SELECT model, b, j, c, n, unnest(range(n)) AS s FROM p JOIN g USING (model, c))),
x AS (SELECT model, b, avg(m) AS x FROM s JOIN o USING (model, c, i) GROUP BY ALL)
SELECT model, round(any_value(y.mean), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM x JOIN (SELECT model, avg(m) AS mean FROM m GROUP BY model) y USING (model) GROUP BY model"""
query("q_bootstrap_clustered", _CLUSTERED)(lambda s, d: _rounded(T.bootstrap(runs(s, d).withColumn("parent", F.col("cell") % 97).withColumn("c", F.col("cell") % 97 % 7), ["model"], "parent", "secs", draws=2000, cluster="c")))
query("q_attenuation_interval", _interval_sql(f"{_PAIRS}, z AS ({_SAVE}) SELECT model_a, cell % 37 AS parent, avg(ws - tsv) AS m FROM z GROUP BY ALL", 4000, "model_a"))(lambda s, d: _rounded(T.bootstrap(_savings(s, d).withColumn("parent", F.col("cell") % 37), ["model_a"], "parent", "gap")))
query("q_delta_interval", _interval_sql(f"WITH r AS ({RUNS}) SELECT a.model || '-' || b.model AS pair, a.cell % 41 AS parent, avg(CAST(a.valid AS INT) - CAST(b.valid AS INT)) AS m FROM r a JOIN r b ON a.cell = b.cell AND a.model < b.model GROUP BY ALL", 4000, "pair"))(lambda s, d: _delta_interval(s, d))


def _delta_interval(spark, sf_dir):
    p = T.run_pairs(runs(spark, sf_dir), ["cell"]).select(F.concat_ws("-", "model_a", "model_b").alias("pair"), (F.col("cell") % 41).alias("parent"), (F.col("valid_a").cast("int") - F.col("valid_b").cast("int")).alias("d"))
    return _rounded(T.bootstrap(p, ["pair"], "parent", "d"))


# --- adaptation ------------------------------------------------------------------------------
#: Stages: each order is a parent; its lines are the conditions, the part decides the validity.
STAGES = "SELECT l_orderkey AS parent, CASE l_linenumber WHEN 1 THEN 'base' WHEN 2 THEN 'related' ELSE 'unrelated' END AS condition, l_partkey % 3 <> 0 AS valid, l_linenumber FROM lineitem"


def stages(spark, sf_dir):
    c = F.when(F.col("l_linenumber") == 1, "base").when(F.col("l_linenumber") == 2, "related").otherwise("unrelated")
    return t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), c.alias("condition"), (F.col("l_partkey") % 3 != 0).alias("valid"), "l_linenumber")


query("q_adaptation", f"WITH s AS ({STAGES}) SELECT condition, count(*) AS n, count(*) FILTER (valid) AS adapted, round(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 6) AS rate FROM s WHERE condition <> 'base' AND parent IN (SELECT parent FROM s WHERE condition = 'base' AND valid) GROUP BY condition")(lambda s, d: T.adaptation(stages(s, d), ["parent"]).withColumn("rate", F.round("rate", 6)))
query("q_stage_fold", "SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, count(*) AS attempts FROM orders GROUP BY o_custkey")(lambda s, d: T.fold_stages(t(s, d, "orders").withColumn("attempt", F.col("o_orderkey")), ["o_custkey"], ["o_orderkey"], ["o_orderstatus"]))
query("q_bounds", "SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6) AS low, round(avg(CASE WHEN o_orderstatus IN ('F', 'P') THEN 1.0 ELSE 0 END), 6) AS high FROM orders GROUP BY o_orderpriority")(
    lambda s, d: T.availability(t(s, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "P", "unresolved").otherwise("refuted")), ["o_orderpriority"]).select("o_orderpriority", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
)
query("q_common_support", f"SELECT cell FROM ({RUNS}) WHERE valid GROUP BY cell HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM ({RUNS}))")(lambda s, d: T.common_support(runs(s, d), ["cell"], "model"))
query("q_hier_mean", f"WITH s AS (SELECT parent % 5 AS a, parent % 35 AS b, CASE WHEN l_linenumber = 3 THEN NULL ELSE valid END AS v FROM ({STAGES})), x AS (SELECT a, b, avg(CASE WHEN v THEN 1.0 ELSE 0 END) AS lo, avg(CASE WHEN v OR v IS NULL THEN 1.0 ELSE 0 END) AS hi FROM s GROUP BY a, b), y AS (SELECT a, avg(lo) AS lo, avg(hi) AS hi FROM x GROUP BY a) SELECT round(avg(lo), 6) AS low, round(avg(hi), 6) AS high FROM y")(
    lambda s, d: T.hierarchical_bounds(stages(s, d).select((F.col("parent") % 5).alias("a"), (F.col("parent") % 35).alias("b"), F.when(F.col("l_linenumber") != 3, F.col("valid")).alias("v")), ["a", "b"], "v").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
)
query("q_pass_k", "SELECT o_custkey, round(CASE WHEN n >= 2 THEN CAST(s AS DOUBLE) * greatest(s - 1, 0) / (n * (n - 1)) END, 6) AS p FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS s FROM orders GROUP BY o_custkey)")(
    lambda s, d: t(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("s")).select("o_custkey", F.round(C.pass_k_column(F.col("s"), F.col("n"), 2), 6).alias("p"))
)
query("q_budget", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice <= 100000 THEN true WHEN o_orderstatus = 'P' AND o_totalprice < 100000 THEN NULL ELSE false END AS met FROM orders")(lambda s, d: t(s, d, "orders").select("o_orderkey", T.budget_met(F.col("o_totalprice"), F.lit(100000.0), F.col("o_orderstatus") == "P", F.col("o_orderstatus") == "F").alias("met")))
query("q_all_known", "SELECT c_custkey, (c_acctbal > 0) AND (CASE WHEN c_nationkey > 3 THEN c_nationkey > 10 END) AS k FROM customer")(lambda s, d: t(s, d, "customer").select("c_custkey", T.all_known([F.col("c_acctbal") > 0, F.when(F.col("c_nationkey") > 3, F.col("c_nationkey") > 10)]).alias("k")))
query("q_tolerant", "SELECT l_orderkey, l_linenumber, abs(l_extendedprice - l_extendedprice * (1 + l_tax / 1000)) <= greatest(0.005, 0.0001 * abs(l_extendedprice * (1 + l_tax / 1000))) AS near FROM lineitem")(lambda s, d: t(s, d, "lineitem").select("l_orderkey", "l_linenumber", C.tolerant_equal(F.col("l_extendedprice"), F.col("l_extendedprice") * (1 + F.col("l_tax") / 1000)).alias("near")))
query("q_numeric_text", "SELECT event_id, CASE WHEN regexp_full_match(x, '-?(0|[1-9][0-9]*)(\\.[0-9]+)?') THEN CAST(x AS DOUBLE) END AS v FROM (SELECT event_id, json_extract_string(props, '$.k') AS x FROM events)")(lambda s, d: _numeric(s, d))


def _numeric(spark, sf_dir):
    from loomwork.operators.domains import numeric_text

    return t(spark, sf_dir, "events").select("event_id", numeric_text(F.get_json_object("props", "$.k")).alias("v"))


# --- ledgers -------------------------------------------------------------------------------------
@query("q_chain_check", "SELECT o_custkey AS run_id, n AS sequence FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n > 0 AND o_orderkey % 10 = 0")
def chain_check(spark, sf_dir):
    """A customer's orders as a ledger whose entries of keys divisible by ten are broken."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), (F.row_number().over(w) - 1).alias("sequence"), F.col("o_orderkey").alias("monotonic_ns"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"), F.lag("o_orderkey").over(w).alias("before"))
    broken = (F.col("monotonic_ns") % 10 == 0) & F.col("before").isNotNull()
    previous = F.when(broken, "wrong").otherwise(F.sha2(F.col("before").cast("string"), 256))
    return T.chain_faults(rows.withColumn("previous_sha256", previous))


query("q_manifest_gaps", "SELECT count(*) AS expected, count(l.doc_id) AS received, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")(lambda s, d: T.manifest_gaps(t(s, d, "documents"), t(s, d, "labels"), ["doc_id"]))


@query("q_node_states", "SELECT o_orderkey AS node_id FROM orders WHERE o_orderkey % 6 = 0")
def node_states(spark, sf_dir):
    """Every order goes through all states; those divisible by six skip `ready`."""
    names = F.array(*map(F.lit, ("queued", "ready", "started", "finished")))
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"), F.posexplode(names).alias("sequence", "state"))
    return T.node_state_faults(rows.where("not (node_id % 6 = 0 and state = 'ready')")).select("node_id")


# --- metrics -------------------------------------------------------------------------------------
@query("q_metric_recall", "SELECT 'M04' AS metric, count(*) FILTER (o_orderstatus = 'F') AS numerator, count(*) AS denominator, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS value, 'MEASURED' AS status FROM orders")
def metric_recall(spark, sf_dir):
    """Required: all orders; returned: those of status F."""
    o = t(spark, sf_dir, "orders")
    out = M.recall(o.select(F.col("o_orderkey").alias("id")), o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))
    return out.withColumn("value", F.round("value", 6))


query("q_metric_precision", "SELECT 'M05' AS metric, count(*) FILTER (o_orderstatus = 'F') AS numerator, count(*) AS denominator, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS value, 'MEASURED' AS status FROM orders WHERE o_orderkey > 100")(
    lambda s, d: M.precision(t(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), t(s, d, "orders").where("o_orderkey > 100").select(F.col("o_orderkey").alias("id"))).withColumn("value", F.round("value", 6))
)
query("q_metric_not_applicable", "SELECT 'M05' AS metric, CAST(0 AS BIGINT) AS numerator, CAST(0 AS BIGINT) AS denominator, CAST(NULL AS DOUBLE) AS value, 'NOT_APPLICABLE' AS status")(lambda s, d: M.precision(t(s, d, "orders").select(F.col("o_orderkey").alias("id")), t(s, d, "orders").where("false").select(F.col("o_orderkey").alias("id"))))


# --- streaming -----------------------------------------------------------------------------------
@query("q_streaming_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def streaming_counts(spark, sf_dir):
    """Windowed counts over the events table read as a stream until it is used up."""
    from loomwork.streaming.events import daily_counts

    return daily_counts(spark, f"{sf_dir}/events.parquet")


# --- scoring and reuse -----------------------------------------------------------------------
#: Expected records: all orders, dealt to two models; some never ran, some were cut short.
_SCORED = """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'm0' ELSE 'm1' END AS model, o_custkey % 3 AS family,
  CASE WHEN o_orderkey % 13 = 0 THEN 'MISSING_EVIDENCE' WHEN o_orderkey % 11 = 0 THEN 'TIMEOUT' ELSE 'COMPLETED' END AS status,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN false ELSE o_orderstatus <> 'P' END AS s,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN false WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_custkey > 1000 THEN false END ELSE o_custkey <= 1000 END AS b
FROM orders"""


def scored(spark, sf_dir):
    from loomwork.functions import metrology as Y

    o = t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    levels = [F.lit(0).alias(c) for c in Y.LEVELS[1:]]
    expected = o.select(k.alias("record_id"), F.when(k % 2 == 0, "m0").otherwise("m1").alias("model"), F.lit("p").alias("protocol"), k.alias("case_id"), F.lit(1000.0).alias("wall_budget"), F.lit(None).cast("double").alias("memory_budget"), (F.col("o_custkey") % 3).alias("family"), *levels)
    seen = o.where("o_orderkey % 13 <> 0").select(k.alias("record_id"), F.when(k % 11 == 0, "TIMEOUT").otherwise("COMPLETED").alias("status"), (F.col("o_orderstatus") != "P").alias("semantic_pass"), F.col("o_custkey").cast("double").alias("wall_s"), F.when(k % 7 == 0, "CENSORED").otherwise("MEASURED").alias("wall_status"), F.lit(1.0).alias("memory"), F.lit("MEASURED").alias("memory_status"))
    refs = o.where("o_orderkey % 5 = 0").select(k.alias("case_id"), F.lit(400.0).alias("time_s"))
    return Y.score_repeats(expected, seen, refs)


query("q_score_repeats", f"SELECT o_orderkey AS record_id, status, s AS S, b AS B, CASE WHEN status <> 'MISSING_EVIDENCE' THEN s AND b END AS V FROM ({_SCORED})".replace(" AS S", ' AS "S"').replace(" AS B", ' AS "B"').replace(" AS V", ' AS "V"'))(lambda s, d: scored(s, d).select("record_id", "status", "S", "B", "V"))
query("q_score_panels", f"WITH v AS (SELECT model, family, CASE WHEN status <> 'MISSING_EVIDENCE' THEN s AND b END AS v FROM ({_SCORED})), f AS (SELECT model, family, avg(CASE WHEN v THEN 1.0 ELSE 0 END) AS lo, avg(CASE WHEN v OR v IS NULL THEN 1.0 ELSE 0 END) AS hi, count(*) AS n FROM v GROUP BY ALL) SELECT model, round(avg(lo), 6) AS low, round(avg(hi), 6) AS high, CAST(sum(n) AS BIGINT) AS expected FROM f GROUP BY model")(lambda s, d: _panels(s, d))


def _panels(spark, sf_dir):
    from loomwork.functions import metrology as Y

    return Y.score_panels(scored(spark, sf_dir)).select("model", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "expected")


@query("q_compatible_view", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 10 = 0)")
def compatible(spark, sf_dir):
    """Orders that hold a part divisible by ten changed; the others' lines stay usable."""
    from loomwork.functions.metrology import compatible_view

    rows = t(spark, sf_dir, "lineitem")
    new = rows.select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 10 == 0, -1.0).otherwise(F.col("l_quantity")).alias("l_quantity"))
    return compatible_view(rows.select("l_orderkey", "l_linenumber", "l_quantity"), new, ["l_orderkey"])


@query("q_replay_fidelity", "SELECT l_orderkey AS run, count(*) FILTER (l_partkey % 10 = 0) = 0 AS same FROM lineitem GROUP BY l_orderkey")
def replay_fidelity(spark, sf_dir):
    from loomwork.functions.metrology import replay_fidelity as check

    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), "l_linenumber", "l_quantity", "l_partkey")
    new = rows.withColumn("l_quantity", F.when(F.col("l_partkey") % 10 == 0, -1.0).otherwise(F.col("l_quantity")))
    return check(rows, new.repartition(3), ["run"])


@query("q_claim_support", "SELECT c_custkey AS claim, CASE WHEN c_custkey % 3 = 0 THEN 'contradicted' WHEN c_custkey % 7 = 0 THEN 'pending' ELSE 'supported' END AS status FROM customer")
def claim_support(spark, sf_dir):
    from loomwork.functions.metrology import claim_support as check

    c = t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    claims = c.select(k.alias("claim"), k.alias("entity"), F.lit("segment").alias("field"), F.when(k % 3 == 0, "none").otherwise(F.col("c_mktsegment")).alias("value"))
    facts = c.where("not (c_custkey % 7 = 0 and c_custkey % 3 <> 0)").select(k.alias("entity"), F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value"))
    return check(claims, facts)


query("q_refresh_matrix", "SELECT o_orderstatus, o_orderkey % 2 = 0 AS answer, o_custkey % 2 = 0 AS evidence, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS updated, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0 END), 6) AS rate FROM orders GROUP BY ALL")(lambda s, d: _refresh(s, d))


def _refresh(spark, sf_dir):
    from loomwork.functions.metrology import refresh_matrix

    rows = t(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_orderkey") % 2 == 0).alias("answer"), (F.col("o_custkey") % 2 == 0).alias("evidence"), (F.col("o_orderkey") % 3 == 0).alias("valid"))
    return refresh_matrix(rows, ["o_orderstatus"], "answer", "evidence", "valid").withColumn("rate", F.round("rate", 6))


query("q_pairwise_delta", f"WITH r AS ({RUNS}) SELECT a.model AS a, b.model AS b, count(*) AS n, CAST(sum(CAST(a.valid AS INT)) AS BIGINT) AS valid_a, CAST(sum(CAST(b.valid AS INT)) AS BIGINT) AS valid_b, round(avg(CAST(a.valid AS INT) - CAST(b.valid AS INT)), 6) AS delta FROM r a JOIN r b ON a.cell = b.cell AND a.model < b.model GROUP BY ALL")(lambda s, d: _delta(s, d))


def _delta(spark, sf_dir):
    from loomwork.functions.metrology import pairwise_delta

    return pairwise_delta(runs(spark, sf_dir), ["cell"], "model", "valid").withColumn("delta", F.round("delta", 6))


@query("q_component_savings", f"{_PAIRS} SELECT cell, model_a, model_b, round(CASE WHEN greatest(a1, b1) > 0 THEN 1 - least(a1, b1) / greatest(a1, b1) END, 6) AS w1, round(CASE WHEN greatest(a2, b2) > 0 THEN 1 - least(a2, b2) / greatest(a2, b2) END, 6) AS w2 FROM p")
def component_savings(spark, sf_dir):
    from loomwork.functions.metrology import component_savings as pivot

    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(f"{u}_a").cast("double").alias("work_a"), F.col(f"{u}_b").cast("double").alias("work_b")) for u in ("w1", "w2")])).alias("x")
    keys = ["cell", "model_a", "model_b"]
    out = pivot(pairs(spark, sf_dir).select(*keys, units).select(*keys, "x.*"), keys)
    return out.select(*keys, F.round("w1", 6).alias("w1"), F.round("w2", 6).alias("w2"))


query("q_outcome_campaign", "SELECT coalesce(CASE WHEN quality = 1 THEN 'COMPLETED' WHEN quality = 0 THEN 'MODEL_FAILURE' END, 'MISSING') AS status, count(*) AS n FROM documents LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id) GROUP BY 1")(lambda s, d: _campaign(s, d))


def _campaign(spark, sf_dir):
    from loomwork.functions.metrology import outcome_counts

    attempts = t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "COMPLETED").otherwise("MODEL_FAILURE").alias("status"))
    return outcome_counts(attempts, t(spark, sf_dir, "documents"), ["doc_id"])
