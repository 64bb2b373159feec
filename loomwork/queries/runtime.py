"""The workflow runtime's records, sources that are written and read back, rules on values, and
cohort checks. Rules that run on the driver are held against their answers written out as VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import canonical, metrology, traces
from loomwork.functions import compare as C
from loomwork.functions import metrics as M
from loomwork.operators import documents, domains
from loomwork.operators import graph as G
from loomwork.operators.base import Value
from loomwork.plans.compiler import comparison_identity, compile_plan, execution_identity
from loomwork.plans.ir import reaches, topological
from loomwork.plans.predicates import MAX_DEPTH, MAX_NODES, analyze, call, field, lit
from loomwork.plans.types import Type, TypeFault, record, scalar
from loomwork.plans.workflow import Faults, Node, Workflow, replay
from loomwork.queries.analytics import RUNS, pairs, runs
from loomwork.queries.base import op, query, scan, t
from loomwork.sources import registry
from loomwork.sources.storage import scratch

# --- sources that are written and read back ----------------------------------------------------


@query("q_json_lines", "SELECT n_nationkey, n_name FROM nation")
def json_lines(spark, sf_dir):
    """Strict JSON lines with the file's digest and number of rows checked."""
    path = scratch(spark, "nation.jsonl")
    nation = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    nation.select(F.to_json(F.struct("n_nationkey", "n_name"))).coalesce(1).write.text(path)  # the file of one source
    sha256 = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).scalar()
    digest = spark.range(1).select(sha256).first()[0]
    rows = registry.read_json_lines(spark, path, record(n_nationkey=scalar("Int64"), n_name=scalar("Utf8")), nation.count(), digest)
    return rows.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("q_json_export", "SELECT r_regionkey, r_name FROM region")
def json_export(spark, sf_dir):
    """A whole JSON document: an array of objects over several lines."""
    path = scratch(spark, "region.json")
    rows = t(spark, sf_dir, "region").agg(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("a"))
    rows.select(F.to_json("a", {"pretty": "true"})).write.text(path)
    return registry.read_json_export(spark, path, "r_regionkey int, r_name string")


@query("q_csv_round_trip", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def csv_round_trip(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    path = scratch(spark, "customer.csv")
    registry.write_csv(rows, path)
    return registry.read_csv(spark, path, rows.schema)


@query("q_csv_byte_order_mark", "SELECT r_regionkey, r_name FROM region")
def csv_byte_order_mark(spark, sf_dir):
    path = scratch(spark, "region.csv")
    rows = t(spark, sf_dir, "region").agg(F.sort_array(F.collect_list(F.concat_ws(",", "r_regionkey", "r_name"))).alias("a"))
    rows.select(F.concat(F.lit("﻿r_regionkey,r_name\n"), F.array_join("a", "\n"))).write.text(path)
    return registry.read_csv(spark, path, "r_regionkey int, r_name string")


@query("q_append_log", "SELECT s_suppkey, s_name FROM supplier")
def append_log(spark, sf_dir):
    """Two appends to a log of JSON lines; readers see both."""
    path, rows = scratch(spark, "log"), t(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    registry.append_log(rows.where("s_suppkey % 2 = 0"), path)
    registry.append_log(rows.where("s_suppkey % 2 <> 0"), path)
    return spark.read.schema(rows.schema).json(path)


@query("q_source_tree", "SELECT r_regionkey AS folder, r_name || chr(10) AS text FROM region")
def source_tree(spark, sf_dir):
    path = scratch(spark, "tree")
    t(spark, sf_dir, "region").select("r_regionkey", "r_name").write.partitionBy("r_regionkey").text(path)
    tree = registry.read_tree(spark, path, "*.txt")
    return tree.select(F.regexp_extract("path", r"r_regionkey=(\d+)", 1).cast("int").alias("folder"), "text")


@query("q_probe_inputs", "SELECT url AS path, html AS text FROM pages WHERE page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def probe_inputs(spark, sf_dir):
    """The pages that a label calls toxic; a url may be that of several pages."""
    files = t(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("text"), "page_id")
    wanted = t(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return documents.read_probe_inputs(files, wanted, "page_id")


query("q_text_digest", "SELECT doc_id, sha256(text) AS sha256 FROM documents")(lambda s, d: t(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256")))
query("q_row_digest", "SELECT c_custkey, sha256(to_json({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment})) AS digest FROM customer")(
    lambda s, d: (lambda c: c.select("c_custkey", canonical.row_digest(c, ["c_mktsegment", "c_custkey"]).alias("digest")))(t(s, d, "customer"))
)

_STATUS = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"
_CANONICAL = f"SELECT '[' || string_agg('{{\"n\":' || n || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}}', ',' ORDER BY o_orderstatus) || ']' AS artifact FROM ({_STATUS})"


@query("q_emit_artifact", f"SELECT artifact, sha256(artifact) AS sha256 FROM ({_CANONICAL})")
def emit_artifact(spark, sf_dir):
    """The canonical JSON of a result and its digest, under its contract."""
    rows = op("aggregate", "hash_group", {"rows": scan(spark, sf_dir, "orders", ["o_orderstatus"])}, {"group_by": ["o_orderstatus"], "aggregates": [{"function": "count", "as": "n"}]})
    rows = op("sort", "in_memory", {"rows": Value(rows.df, rows.type)}, {"keys": [{"field": "o_orderstatus"}]})
    out = op("emit", "json_artifact", {"rows": rows}, {"output_contract": "statuses"})
    return spark.createDataFrame([out.notes["canonical"]()], "artifact string, sha256 string")


@query("q_materialize_ipc", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000")
def materialize_ipc(spark, sf_dir):
    rows = scan(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"], call("ge", field("o_totalprice"), lit(200000.0)))
    return op("materialize", "disk", {"rows": rows}, {"format": "arrow_ipc"}).visible()


# --- workflow runtime ----------------------------------------------------------------------------
def _tools(spark, sf_dir) -> dict:
    return {"read": lambda name: t(spark, sf_dir, name), "count": lambda rows: rows.count(), "add": lambda a, b: a + b, "fail": lambda: 1 // 0, "update": lambda: "updated"}


def _run(spark, sf_dir) -> Workflow:
    """Two tables are read and counted, the counts added; one node fails, and one waits for it."""
    w = Workflow(spark, _tools(spark, sf_dir), slots=2)
    w.edit([Node("n", "read", {"name": "nation"}), Node("r", "read", {"name": "region"}), Node("a", "count", {"rows": {"$ref": "n"}}), Node("b", "count", {"rows": {"$ref": "r"}}), Node("sum", "add", {"a": {"$ref": "a"}, "b": {"$ref": "b"}})])
    w.edit([Node("bad", "fail", {}), Node("after", "add", {"a": {"$ref": "bad"}, "b": 1})])
    w.dispatch()
    return w


def _values(rows: str, columns: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) v({columns})"


@query("q_wf_events", _values("('edit', 'COMPLETED', 2::BIGINT), ('worker_started', 'RUNNING', 6), ('artifact', 'COMPLETED', 5), ('worker_finished', 'COMPLETED', 5), ('worker_failed', 'FAILED', 1)", "kind, status, n"))
def wf_events(spark, sf_dir):
    return _run(spark, sf_dir).event_table().groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


query("q_wf_dispatch", _values("('n', 'COMPLETED'), ('r', 'COMPLETED'), ('a', 'COMPLETED'), ('b', 'COMPLETED'), ('sum', 'COMPLETED'), ('bad', 'FAILED'), ('after', 'PENDING')", "node, status"))(lambda s, d: s.createDataFrame([(n.id, n.status) for n in _run(s, d).nodes.values()], "node string, status string"))


@query("q_wf_artifacts", "SELECT k AS kind, c AS content, refs FROM (VALUES ('value', (SELECT CAST(count(*) AS VARCHAR) FROM nation), 1), ('value', (SELECT CAST(count(*) AS VARCHAR) FROM region), 1), ('value', (SELECT CAST((SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS VARCHAR)), 2)) v(k, c, refs)")
def wf_artifacts(spark, sf_dir):
    """The values that were computed, with the number of artifacts each came from."""
    return _run(spark, sf_dir).artifact_table().where("kind = 'value' and content_hash = sha2(content, 256)").select("kind", "content", F.size("input_refs").alias("refs"))


@query("q_wf_lineage", _values("('n'), ('r'), ('a'), ('b'), ('sum')", "task_id"))
def wf_lineage(spark, sf_dir):
    """The tasks whose artifacts the sum comes from, itself included."""
    w = _run(spark, sf_dir)
    table = w.artifact_table()
    edges = table.select(F.col("artifact_id").alias("child"), F.explode("input_refs").alias("parent"))
    ids = G.ancestors(edges, spark.createDataFrame([(w.artifact_of["sum"],)], "id string"))
    made = table.join(ids, table["artifact_id"] == ids["id"]).select("producer_event_id")
    return w.event_table().join(made, F.col("event_id") == F.col("producer_event_id")).select("task_id")


@query("q_artifact_read", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def artifact_read(spark, sf_dir):
    w = _run(spark, sf_dir)
    return w.read_artifact(w.artifact_of["n"])


query("q_wf_submit", "SELECT n_name FROM nation")(lambda s, d: _run(s, d).submit({"node": "n", "column": "n_name"}))


@query("q_wf_reference", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def wf_reference(spark, sf_dir):
    """A path of one name on a table gives that column."""
    tools = _tools(spark, sf_dir) | {"group": lambda rows: rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))}
    w = Workflow(spark, tools)
    w.edit([Node("c", "read", {"name": "customer"}), Node("g", "group", {"rows": {"$ref": "c", "path": ["c_mktsegment"]}})])
    w.dispatch()
    return w.results["g"]


@query("q_wf_edits", _values("('a cycle', false), ('an unknown dependency', false), ('a node twice', false), ('a cancelled dependency', false), ('a revision', true), ('a new node', true)", "edit, accepted"))
def wf_edits(spark, sf_dir):
    """Each edit is taken whole or refused whole."""
    w = _run(spark, sf_dir)
    w.edit(cancel=["after"])
    edits = {
        "a cycle": {"add": [Node("x", "add", {"a": {"$ref": "y"}, "b": 1}), Node("y", "add", {"a": {"$ref": "x"}, "b": 1})]},
        "an unknown dependency": {"add": [Node("x", "add", {"a": {"$ref": "nowhere"}, "b": 1})]},
        "a node twice": {"add": [Node("sum", "add", {"a": 1, "b": 1})]},
        "a cancelled dependency": {"add": [Node("x", "add", {"a": {"$ref": "after"}, "b": 1})]},
        "a revision": {"revise": {"sum": {"arguments": {"a": {"$ref": "a"}, "b": 100}}}},
        "a new node": {"add": [Node("z", "add", {"a": {"$ref": "sum"}, "b": 1})]},
    }
    out = []
    for name, edit in edits.items():
        before = set(w.nodes)
        try:
            w.edit(**edit)
            out.append((name, True))
        except (TypeFault, KeyError):
            out.append((name, set(w.nodes) != before))
    return spark.createDataFrame(out, "edit string, accepted boolean")


@query("q_wf_revision", "SELECT 2 AS revision, CAST(100 + (SELECT count(*) FROM nation) AS BIGINT) AS result")
def wf_revision(spark, sf_dir):
    w = _run(spark, sf_dir)
    w.edit(revise={"sum": {"arguments": {"a": {"$ref": "a"}, "b": 100}}})
    w.dispatch()
    return spark.createDataFrame([(w.nodes["sum"].revision, w.results["sum"])], "revision int, result long")


query("q_wf_failures", _values("('bad', true)", "node, zero_division"))(lambda s, d: s.createDataFrame([(k, "ZeroDivisionError" in e) for k, e in _run(s, d).latest_failures().items()], "node string, zero_division boolean"))


@query("q_wf_faults", _values("(1, 'first read fails', 'FAILED'), (2, 'first read fails', 'COMPLETED'), (1, 'reply lost', 'FAILED'), (2, 'reply lost', 'COMPLETED'), (1, 'stale reader', 'COMPLETED'), (2, 'stale reader', 'COMPLETED')", "attempt, fault, status"))
def wf_faults(spark, sf_dir):
    """A node that fails is revised and tried again."""
    out = []
    for fault, how in (("first read fails", {"fail_first": 1}), ("reply lost", {"lose_reply": 1}), ("stale reader", {"stale": True})):
        w = Workflow(spark, {"read": Faults(lambda: 1, **how)})
        w.edit([Node("x", "read", {})])
        for attempt in (1, 2):
            out.append((attempt, fault, w.dispatch()["x"]))
            w.edit(revise={"x": {"arguments": {}}})
    return spark.createDataFrame(out, "attempt int, fault string, status string")


@query("q_wf_version", _values("('n', '1'), ('u', '2'), ('r', '2')", "task_id, input_version"))
def wf_version(spark, sf_dir):
    """A trigger moves the source to its next version once; later artifacts carry it."""
    w = Workflow(spark, _tools(spark, sf_dir), slots=1)
    w.triggers["update"] = "2"
    for node in (Node("n", "read", {"name": "nation"}), Node("u", "update", {}), Node("r", "read", {"name": "region"})):
        w.edit([node])
        w.dispatch()
    return w.event_table().where("kind = 'artifact'").select("task_id", F.col("input_versions")["source"].alias("input_version"))


@query("q_wf_continuation", _values("(true, 0::BIGINT, 0::BIGINT), (false, 1, 0)", "inherited, finished_later, costly_before"))
def wf_continuation(spark, sf_dir):
    """A branch inherits the events before it: at negative times and at no cost."""
    w = _run(spark, sf_dir)
    branch = Workflow.continuation(spark, _tools(spark, sf_dir), w.checkpoint())
    branch.edit([Node("more", "add", {"a": {"$ref": "sum"}, "b": 1})])
    branch.dispatch()
    late = (F.col("kind") == "worker_finished") & (F.col("monotonic_end") > 0)
    cost = (F.col("monotonic_end") <= 0) & (F.size("resource_delta") > 0)
    return branch.event_table().groupBy("inherited").agg(F.count_if(late).alias("finished_later"), F.count_if(cost).alias("costly_before"))


@query("q_wf_replay", "SELECT CAST(count(*) AS BIGINT) AS n, true AS same FROM nation")
def wf_replay(spark, sf_dir):
    """A stored list of decisions run twice gives equal artifacts."""
    decisions = [{"add": [{"id": "n", "tool": "read", "arguments": {"name": "nation"}}]}, {"add": [{"id": "c", "tool": "count", "arguments": {"rows": {"$ref": "n"}}}]}]
    a, b = (replay(spark, _tools(spark, sf_dir), decisions) for _ in range(2))
    same = [x["content_hash"] for x in a.artifacts.values()] == [x["content_hash"] for x in b.artifacts.values()]
    return spark.createDataFrame([(a.results["c"], same)], "n long, same boolean")


@query("q_identity", _values("('same task, other plan', true, false), ('same task and plan, next repeat', true, false), ('other task', false, true), ('all equal', true, true)", "what, comparable, same_execution"))
def identity(spark, sf_dir):
    task, plan = {"id": "t", "data": "d"}, {"nodes": [1]}
    rows = [("same task, other plan", task, {"nodes": [2]}, 0), ("same task and plan, next repeat", task, plan, 1), ("other task", {"id": "u"}, plan, 0), ("all equal", dict(reversed(task.items())), plan, 0)]
    return spark.createDataFrame([(n, comparison_identity(x) == comparison_identity(task), execution_identity(p, r) == execution_identity(plan, 0)) for n, x, p, r in rows], "what string, comparable boolean, same_execution boolean")


@query("q_campaign", "SELECT o_orderpriority AS arm, count(*) AS expected, count(*) FILTER (o_orderstatus <> 'P') AS received, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS rate FROM orders GROUP BY o_orderpriority")
def campaign(spark, sf_dir):
    """Attempts declared beforehand: those that never came back stay in the denominator."""
    o = t(spark, sf_dir, "orders")
    expected = o.select(F.col("o_orderkey").alias("attempt"), F.col("o_orderpriority").alias("arm"))
    observed = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("attempt"), (F.col("o_orderstatus") == "F").alias("success"))
    return metrology.campaign_rates(expected, observed, ["attempt"], "arm", "success").withColumn("rate", F.round("rate", 6))


# --- plans: order, limits, loops ----------------------------------------------------------------
_NEEDS = {"a": set(), "b": {"a"}, "c": {"a"}, "d": {"b", "c"}, "e": set()}
query("q_topological", _values("('a', 0), ('b', 1), ('c', 2), ('d', 3), ('e', 4)", "node, place"))(lambda s, d: s.createDataFrame([(n, i) for i, n in enumerate(topological(_NEEDS))], "node string, place int"))
query("q_precedes", _values("('a', 'b'), ('a', 'c'), ('a', 'd'), ('b', 'd'), ('c', 'd')", "first, later"))(lambda s, d: s.createDataFrame([(x, y) for x in _NEEDS for y in _NEEDS if x != y and reaches(_NEEDS, x, y)], "first string, later string"))


@query("q_cycle", _values("('a needs b needs a', true), ('a needs b', false)", "graph, cyclic"))
def cycle(spark, sf_dir):
    def cyclic(needs: dict) -> bool:
        try:
            topological(needs)
            return False
        except TypeFault:
            return True

    return spark.createDataFrame([("a needs b needs a", cyclic({"a": {"b"}, "b": {"a"}})), ("a needs b", cyclic({"a": {"b"}, "b": set()}))], "graph string, cyclic boolean")


@query("q_critical_path", "WITH s AS (SELECT l_orderkey AS o, l_linenumber AS n, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY ALL) SELECT max(total) AS seconds FROM (SELECT o, sum(q) AS total FROM s GROUP BY o)")
def critical_path(spark, sf_dir):
    """The lines of an order as a chain of tasks, the quantity their time: the longest order."""
    spans = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.sum("l_quantity").cast("double").alias("seconds"))
    task = F.concat_ws(":", "o", "n").alias("task_id")
    a, b = spans.select("o", F.col("n").alias("n"), task), spans.select("o", F.col("n").alias("m"), task.alias("needs"))
    before = a.join(b, "o").where("m < n").groupBy("task_id").agg(F.max_by("needs", "m").alias("needs"))
    return M.critical_path(spans.select(task, "seconds"), before)


@query("q_predicate_limits", _values("('as deep as allowed', true), ('too deep', false), ('as many nodes as allowed', true), ('too many nodes', false)", "tree, accepted"))
def predicate_limits(spark, sf_dir):
    row = record(x=scalar("Bool"))

    def deep(n: int) -> dict:
        tree = field("x")
        for _ in range(n - 1):
            tree = call("not", tree)
        return tree

    def wide(n: int) -> dict:
        return call("and", *[field("x") for _ in range(n - 1)])

    def accepted(tree: dict) -> bool:
        try:
            analyze(tree, row)
            return True
        except TypeFault:
            return False

    cases = {"as deep as allowed": deep(MAX_DEPTH), "too deep": deep(MAX_DEPTH + 1), "as many nodes as allowed": wide(MAX_NODES), "too many nodes": wide(MAX_NODES + 1)}
    return spark.createDataFrame([(k, accepted(v)) for k, v in cases.items()], "tree string, accepted boolean")


@query("q_expr_count", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def expr_count(spark, sf_dir):
    """A predicate that counts the elements of a list column."""
    rows = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("keys"))
    row = record(o_custkey=scalar("Int64"), keys=Type("List", item=scalar("Int64")))
    count = analyze(call("count", field("keys")), row)
    return rows.where(analyze(call("gt", call("count", field("keys")), lit(12)), row).column()).select("o_custkey", count.column().alias("n"))


def _halve(now: str, k: int) -> list[dict]:
    """One step along the edges, from the rows that now names."""
    return [
        {"id": f"step{k}", "operator": "join", "implementation": "hash", "inputs": {"left": now, "right": "$bound.edges"}, "params": {"keys": [{"left": "id", "right": "child"}], "join_type": "inner"}, "outputs": {"rows": "Table[Record]"}},
        {"id": f"one{k}", "operator": "aggregate", "implementation": "hash_group", "inputs": {"rows": f"step{k}.rows"}, "params": {"aggregates": [{"function": "max", "field": "parent", "as": "id"}]}, "outputs": {"rows": "Table[Record]"}},
    ]


#: Four steps a turn: a loop has 16 turns at most, and a 64-bit key takes up to 62 steps.
_HALVE = {"bindings": {"now": "$state", "edges": "$input.edges"}, "nodes": [n for k in range(4) for n in _halve(f"one{k - 1}.rows" if k else "$bound.now", k)], "yield": {"state": "one3.rows"}}


@query("q_loop_plan", "WITH RECURSIVE r(id) AS (SELECT max(c_custkey) FROM customer UNION ALL SELECT CAST(floor(id / 2) AS BIGINT) FROM r WHERE id > 3) SELECT min(id) AS id FROM r")
def loop_plan(spark, sf_dir):
    """A plan's loop: from the last customer go to half the key while it is above three. A key of
    three or less leads to itself, and keys on the way need not be customers."""
    c = t(spark, sf_dir, "customer")
    start = c.agg(F.max("c_custkey").alias("id"))
    way = start.select(F.explode(F.expr("transform(sequence(1, 62), k -> floor(id / pow(2, k)))")))
    edges = c.select(F.col("c_custkey").alias("child")).union(way).select("child", F.when(F.col("child") > 3, F.floor(F.col("child") / 2)).otherwise(F.col("child")).alias("parent"))
    inputs = {"edges": registry.plain_table(edges), "start": registry.plain_table(start)}
    nodes = [{"id": "turn", "operator": "loop", "implementation": "bounded_loop", "inputs": {"state": "$input.start"}, "params": {"condition": call("gt", field("id"), lit(3)), "max_iterations": 16}, "outputs": {"state": "Table[Record]"}, "regions": {"body": _HALVE}}]
    plan = {"ir_version": "1.0", "task_id": "loop", "external_inputs": {k: k for k in inputs}, "nodes": nodes, "result": "turn.state"}
    return compile_plan(plan, inputs).result.visible()


@query("q_top_k_none", "SELECT o_orderkey, o_totalprice FROM orders LIMIT 0")
def top_k_none(spark, sf_dir):
    """k = 0 reads the source to its end and gives no rows."""
    rows = scan(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"])
    return op("top_k", "streaming_heap", {"rows": rows}, {"keys": [{"field": "o_totalprice"}], "k": 0}).visible()


@query("q_fixture_top_five", "SELECT id, 37 * id % 101 AS score FROM range(64) r(id) WHERE id % 3 <> 0 ORDER BY score DESC, id LIMIT 5")
def fixture_top_five(spark, sf_dir):
    """64 rows with a known answer through scan, filter, top-k and projection."""
    rows = spark.range(64).select("id", (37 * F.col("id") % 101).alias("score"), (F.col("id") % 3 != 0).alias("eligible"))
    kept = op("scan", "sequential", {"source": registry.Registry(spark).add("r", rows, ["id"])}, {"columns": ["id", "score", "eligible"], "predicate": call("eq", field("eligible"), lit(True))})
    best = op("top_k", "streaming_heap", {"rows": kept}, {"keys": [{"field": "score", "direction": "desc"}, {"field": "id"}], "k": 5})
    return op("project", "column_view", {"rows": best}, {"columns": ["id", "score"]}).visible()


# --- joins, state, search ------------------------------------------------------------------------
@query("q_using_join", "SELECT custkey, c_mktsegment, count(*) AS n FROM (SELECT o_custkey AS custkey FROM orders) JOIN (SELECT c_custkey AS custkey, c_mktsegment FROM customer) USING (custkey) GROUP BY ALL")
def using_join(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    customers = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    return domains.using(orders, customers, ["custkey"]).groupBy("custkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


query("q_scrub", "SELECT event_id, CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END AS value FROM events")(
    lambda s, d: t(s, d, "events").select("event_id", C.scrub(F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 1, F.lit(float("-inf"))).otherwise(F.col("value"))).alias("value"))
)
query("q_log_samples", "SELECT role AS service, n, text FROM (SELECT role, text, CAST(row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS INTEGER) AS n FROM conversations WHERE regexp_matches(text, '(?i)th[ae]')) WHERE n <= 3")(
    lambda s, d: domains.log_samples(t(s, d, "conversations"), "th[ae]", 3, ["conv_id", "turn"], "role", "text").withColumnRenamed("role", "service")
)
query("q_publication_records", "SELECT o_custkey AS author, o_orderkey AS paper, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(floor(o_totalprice) AS BIGINT) AS citations FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996")(lambda s, d: _publications(s, d))


def _publications(spark, sf_dir) -> DataFrame:
    from loomwork.queries.graphs import authorship, papers

    return G.publication_records(authorship(spark, sf_dir), papers(spark, sf_dir), (1994, 1996))


_PAPERS = "SELECT o_custkey AS author, o_orderkey AS paper, CAST(floor(o_totalprice) AS BIGINT) AS c FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996"


@query("q_dossier_papers", f"WITH p AS ({_PAPERS}), top AS (SELECT author, first(paper ORDER BY c DESC, paper) AS paper FROM p GROUP BY author) SELECT author, paper, list_sort(list_distinct(list(l_partkey))) AS refs FROM top JOIN lineitem ON l_orderkey = paper GROUP BY author, paper")
def dossier_papers(spark, sf_dir):
    """Every author's most cited paper in the window, with what it refers to."""
    from loomwork.queries.graphs import authorship, papers

    edges = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit(1).alias("type"))
    return G.top_paper_references(authorship(spark, sf_dir), papers(spark, sf_dir), edges, (1994, 1996)).where("size(refs) > 0")


@query("q_shortest_path_nodes", "WITH RECURSIVE m AS (SELECT max(c_custkey) + 1 AS m FROM customer), r(h, id, path) AS (SELECT 0, CAST(1 AS BIGINT), [CAST(1 AS BIGINT)] UNION ALL SELECT h + 1, (id * 7 + 3) % m, list_append(path, (id * 7 + 3) % m) FROM r, m WHERE h < 3) SELECT CAST(1 AS BIGINT) AS source, id AS target, CAST(h AS DOUBLE) AS cost, path FROM r WHERE h = 3")
def shortest_path_nodes(spark, sf_dir):
    """The path itself, along edges of one kind where each node has one way on."""
    from loomwork.queries.graphs import customers, seeds

    g = customers(spark, sf_dir)
    m = t(spark, sf_dir, "customer").agg(F.max("c_custkey") + 1).first()[0]
    target = 1
    for _ in range(3):
        target = (target * 7 + 3) % m
    one = Value(type(g.data)(g.data.nodes, g.data.edges.where("relation <> 'likes'")), g.type)
    return op("graph_shortest_path", "bfs", {"graph": one, "seeds": seeds(g, "id = 1")}, {"target": [target]}).df.select("source", "target", "cost", "path")


_CASES = "SELECT o_orderkey AS check_id, o_custkey AS case_id, o_orderstatus AS observed, 'F' AS expected FROM orders"


@query("q_case_contracts", f"SELECT check_id, case_id, observed, expected FROM ({_CASES}) WHERE observed <> expected AND case_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def case_contracts(spark, sf_dir):
    """Broken contracts, for the cases in scope alone."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("check_id"), F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("observed"))
    scope = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("case_id"))
    return domains.case_contracts(o, o.select("check_id", "case_id", F.lit("F").alias("expected")), scope)


query("q_payment_records", "SELECT o_custkey AS member, o_orderkey AS seq, o_totalprice AS amount FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus = 'F'")(
    lambda s, d: domains.payment_records(t(s, d, "orders").select(F.col("o_custkey").alias("member"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status")), least=100000.0, status="F").drop("status")
)


@query("q_read_state", "SELECT o_custkey AS member, arg_max(o_totalprice, o_orderkey) AS amount FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey")
def read_state(spark, sf_dir):
    """The state after the writes up to a version: here those of even keys."""
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("member"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("amount"), (F.col("o_orderkey") % 2).alias("version"))
    return domains.read_state(o, ["member"], "seq", "version", 0).select("member", "amount")


@query("q_play_state", "SELECT c_custkey AS session, coalesce(p, -1) AS playlist FROM customer LEFT JOIN (SELECT o_custkey, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def play_state(spark, sf_dir):
    """What each session plays after all commands: the last one wins, ties by the larger playlist."""
    state = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), F.lit(-1).cast("long").alias("playlist"))
    o = t(spark, sf_dir, "orders")
    return domains.play(state, o.select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("playlist"), F.col("o_orderdate").alias("at")))


# --- rules on values -----------------------------------------------------------------------------
_EQUAL = [("[1.0, 2.0]", "[2.0001, 1.0]"), ("[[1, 2]]", "[[2, 1]]"), ("1", "1.0"), ("true", "1"), ('{"a": 1, "b": [1, 2]}', '{"b": [1, 2], "a": 1}'), ("1", "2"), ("null", "null"), ('"x"', '"x"')]
_EQUAL_SQL = _values(", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate([("true", "true", "false"), ("false", "true", "false"), ("true", "true", "false"), ("false", "false", "false"), ("true", "true", "true"), ("false", "false", "false"), ("true", "true", "true"), ("true", "true", "true")])), "pair, outer_multiset, all_multisets, canonical")


@query("q_equal_values", _EQUAL_SQL)
def equal_values(spark, sf_dir):
    """Three equalities of JSON values: tolerant with outer lists as multisets and nested rows by
    place, tolerant with all lists as multisets, and byte-exact."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_EQUAL)], "pair int, a string, b string")
    return rows.select("pair", *[C.equal_json(how)("a", "b").alias(how) for how in ("outer_multiset", "all_multisets", "canonical")])


query("q_contains_claim", "SELECT event_id, json_extract_string(props, '$.k') = '69' AS held FROM events")(lambda s, d: t(s, d, "events").select("event_id", metrology.contains_json({"k": 69})("props").alias("held")))

_SHAPES = [("[[[1, 2], [3, 4]]]", "[[1,2],[3,4]]"), ("[1, 2]", "[[1,2]]"), ('{"a": 5, "b": 6}', "[[5,6]]"), ('{"x": 1, "y": 2}', '[["x",1],["y",2]]')]
query("q_normal_shape", _values(", ".join(f"('{a}', '{b}')" for a, b in _SHAPES), "given, rows"))(lambda s, d: s.createDataFrame([(a,) for a, _ in _SHAPES], "given string").select("given", metrology.shape_json(["a", "b"])("given").alias("rows")))

query("q_symbols", "SELECT p_partkey, replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') AS symbol FROM part")(
    lambda s, d: t(s, d, "part").select("p_partkey", metrology.symbol_column(F.concat(F.lit("`"), F.regexp_replace("p_brand", "#", ""), F.lit("`::"), F.regexp_replace("p_name", " ", "_"), F.lit("(x, y)[0]"))).alias("symbol"))
)
query("q_symbol_scope", "SELECT l_orderkey, bool_and(l_returnflag IN ('A', 'R')) AS covered FROM lineitem GROUP BY l_orderkey")(lambda s, d: _symbol_scope(s, d))


def _symbol_scope(spark, sf_dir):
    """An order's lines need the module of their flag; modules A and R are covered as a whole."""
    need = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", F.lit("."), F.col("l_linenumber").cast("string"))).alias("required"))
    return need.select("l_orderkey", metrology.scope_covered(F.col("required"), F.array(F.lit("A"), F.lit("R"))).alias("covered"))


query("q_column_names", "SELECT 'customer' AS tbl, column_name AS name, regexp_replace(lower(column_name), '[^a-z0-9]', '', 'g') AS key FROM (DESCRIBE SELECT * FROM customer)")(lambda s, d: s.createDataFrame([("customer", c, domains.column_key(c)) for c in t(s, d, "customer").columns], "tbl string, name string, key string"))
query("q_aliases", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'OPEN' ELSE o_orderstatus END AS status FROM orders")(lambda s, d: t(s, d, "orders").select("o_orderkey", domains.normalized(F.concat(F.lit(" "), F.lower("o_orderstatus")), {"f": "FINISHED", "o": "OPEN", "p": "P"}).alias("status")))


@query("q_equivalent_sql", _values("('renamed and reordered columns', true, true), ('another count', false, true), ('another table', true, false)", "answer, same_rows, same_tables"))
def equivalent_sql(spark, sf_dir):
    """An answer in SQL counts if it gives the same rows from the same tables."""
    from loomwork.sources.sql_surface import guard, relations

    views = ["orders", "customer"]
    for v in views:
        t(spark, sf_dir, v).createOrReplaceTempView(v)
    ask = lambda text: guard(spark, text, views)
    want = ask("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
    answers = {
        "renamed and reordered columns": "SELECT N, `O-Custkey` FROM (SELECT count(o_orderkey) AS N, o_custkey AS `O-Custkey` FROM orders GROUP BY o_custkey)",
        "another count": "SELECT o_custkey, count(*) + 1 AS n FROM orders GROUP BY o_custkey",
        "another table": "SELECT o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey",
    }
    rows = [(k, metrology.equal_results(ask(v), want), relations(ask(v)) == relations(want)) for k, v in answers.items()]
    return spark.createDataFrame(rows, "answer string, same_rows boolean, same_tables boolean")


@query("q_sql_refused", _values("('a file', true), ('an unlisted view', true), ('an unlisted view in a subquery', true), ('a command', true), ('reflection', true), ('a listed view', false)", "query, refused"))
def sql_refused(spark, sf_dir):
    from loomwork.sources.sql_surface import guard

    for v in ("orders", "customer"):
        t(spark, sf_dir, v).createOrReplaceTempView(v)
    asked = {
        "a file": f"SELECT * FROM parquet.`{sf_dir}/customer.parquet`", "an unlisted view": "SELECT * FROM customer", "an unlisted view in a subquery": "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)",
        "a command": "SET a = 1", "reflection": "SELECT reflect('java.lang.System', 'nanoTime')", "a listed view": "WITH x AS (SELECT * FROM orders) SELECT count(*) FROM x",
    }

    def refused(text: str) -> bool:
        try:
            guard(spark, text, ["orders"])
            return False
        except TypeFault:
            return True

    return spark.createDataFrame([(k, refused(v)) for k, v in asked.items()], "query string, refused boolean")


@query("q_applicability", "SELECT o_orderstatus AS component, count(*) FILTER (o_orderkey % 1000 = 7 AND o_orderstatus = 'F') = 0 AS applicable FROM orders GROUP BY o_orderstatus")
def applicability(spark, sf_dir):
    """Evidence from an old version holds where running it again on the new one gives the same."""
    old = t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("component"), "o_orderkey", "o_totalprice")
    new = old.withColumn("o_totalprice", F.when((F.col("o_orderkey") % 1000 == 7) & (F.col("component") == "F"), F.lit(-1.0)).otherwise(F.col("o_totalprice")))
    return metrology.applicable(old, new, ["component"])


# --- grades, cohorts, savings --------------------------------------------------------------------
query("q_grades", "SELECT doc_id, quality = 1 AS \"Q1\", toxic = 0 AS \"Q2\", quality = 1 AND toxic = 0 AS \"G\" FROM labels")(lambda s, d: M.grades(t(s, d, "labels"), F.col("quality") == 1, F.col("toxic") == 0).select("doc_id", "Q1", "Q2", "G"))


@query("q_primary_work", "SELECT event_id, CASE event_type WHEN 'click' THEN user_id WHEN 'view' THEN event_id WHEN 'error' THEN 1 END AS work FROM events")
def primary_work(spark, sf_dir):
    """The unit of work that counts depends on the scene."""
    unit = {"click": "records_read", "view": "metric_values_read", "error": "native_cases"}
    rows = t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("scene"), F.create_map(F.lit("records_read"), F.col("user_id"), F.lit("metric_values_read"), F.col("event_id"), F.lit("native_cases"), F.lit(1).cast("long")).alias("work"))
    return traces.primary_work(rows, unit).select("event_id", F.col("primary").alias("work"))


_DOMAINS = {"online": "secs", "online_without_wait": "secs - 0.5", "replay_1_slot": "secs + w2", "replay_4_slots": "(secs + w2) / 4"}
_FOUR = " UNION ALL ".join(f"SELECT cell, model_a, model_b, '{k}' AS timing, a1, b1, {v.replace('secs', 'sa').replace('w2', 'a2')} AS ta, {v.replace('secs', 'sb').replace('w2', 'b2')} AS tb FROM p" for k, v in _DOMAINS.items())


@query("q_savings_domains", f"WITH r AS ({RUNS}), p AS (SELECT a.cell, a.model AS model_a, b.model AS model_b, a.w1 AS a1, b.w1 AS b1, a.w2 AS a2, b.w2 AS b2, a.secs AS sa, b.secs AS sb FROM r a JOIN r b ON a.cell = b.cell AND a.model < b.model WHERE a.valid AND b.valid AND a.w1 <> b.w1), d AS ({_FOUR}) SELECT timing, count(*) AS n, round(avg(1 - least(a1, b1) / greatest(a1, b1)), 6) AS work_saving, round(avg(1 - CASE WHEN a1 <= b1 THEN ta / tb ELSE tb / ta END), 6) AS time_saving FROM d WHERE ta > 0 AND tb > 0 GROUP BY timing")
def savings_domains(spark, sf_dir):
    """Savings in all four ways to measure time, matched on the same pairs."""
    p = pairs(spark, sf_dir).where("w1_a <> w1_b").withColumnsRenamed({"w1_a": "work_a", "w1_b": "work_b"})
    exprs = {k: (F.expr(v.replace("secs", "secs_a").replace("w2", "w2_a")), F.expr(v.replace("secs", "secs_b").replace("w2", "w2_b"))) for k, v in _DOMAINS.items()}
    out = traces.savings_by_timing(p, exprs).groupBy("timing").agg(F.count(F.lit(1)).alias("n"), F.avg("work_saving").alias("work_saving"), F.avg("time_saving").alias("time_saving"))
    return out.select("timing", "n", F.round("work_saving", 6).alias("work_saving"), F.round("time_saving", 6).alias("time_saving"))


@query("q_timing_join", f"WITH r AS ({RUNS}) SELECT cell, model, secs AS online, secs + w2 AS replay FROM r WHERE cell % 3 <> 0")
def timing_join(spark, sf_dir):
    """Runs with a time in both domains: those of cells divisible by three were not replayed."""
    r = runs(spark, sf_dir)
    online = r.select("cell", "model", F.col("secs").alias("online"))
    replayed = r.where("cell % 3 <> 0").select("cell", "model", (F.col("secs") + F.col("w2")).alias("replay"))
    return traces.matched_timing([online, replayed], ["cell", "model"])


@query("q_concat_cohorts", "SELECT o_orderkey AS id, 'first' AS cohort, CAST(o_totalprice AS DOUBLE) AS price, CAST(0 AS DOUBLE) AS balance FROM orders UNION ALL SELECT c_custkey, 'second', CAST(0 AS DOUBLE), c_acctbal FROM customer")
def concat_cohorts(spark, sf_dir):
    """Cohorts of different columns one after the other, missing numbers as zero."""
    a = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("first").alias("cohort"), F.col("o_totalprice").alias("price"))
    b = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("second").alias("cohort"), F.col("c_acctbal").alias("balance"))
    return traces.concat_cohorts([a, b])


@query("q_release_checks", "SELECT * FROM (SELECT 'rows' AS name, count(*) = (SELECT count(*) FROM orders) AS passed FROM orders UNION ALL SELECT 'unique', count(*) = count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'balanced', min(n) = max(n) FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL))")
def release_checks(spark, sf_dir):
    """Counts, uniqueness and balance of a released table."""
    o = t(spark, sf_dir, "orders")
    return metrology.release_checks(o, o.count(), ["o_orderkey"], ["o_orderpriority"])


@query("q_update_exposure", "SELECT event_id, CASE WHEN event_id > u THEN 2 ELSE 1 END AS version, event_id > u AS exposed FROM events, (SELECT min(event_id) AS u FROM events WHERE event_type = 'error' AND event_id >= 100)")
def update_exposure(spark, sf_dir):
    """The first trigger moves the source to version 2; whatever comes later is exposed to it."""
    e = t(spark, sf_dir, "events").select("event_id", ((F.col("event_type") == "error") & (F.col("event_id") >= 100)).alias("trigger"))
    return traces.update_exposure(e, "event_id", "trigger")


@query("q_prefix_continuation", "SELECT event_id, event_id % 3 = 0 AS inherited, CASE WHEN event_id % 3 = 0 THEN CAST(event_id - 1000000000 AS DOUBLE) ELSE CAST(event_id AS DOUBLE) END AS \"time\", CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS cost FROM events")
def prefix_continuation(spark, sf_dir):
    """Inherited events (here every third) lie before time zero and cost nothing."""
    e = t(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("double").alias("time"), F.col("value").alias("cost"))
    return traces.continued(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), 1e9, "time", "cost")


@query("q_scan_in_file_order", "SELECT doc_id FROM documents WHERE n_chars > 2000 ORDER BY doc_id")
def scan_in_file_order(spark, sf_dir):
    """A source without order keys: the predicate reaches the scan, rows keep the files' order."""
    reg = registry.Registry(spark).parquet("documents", f"{sf_dir}/documents.parquet")
    return op("scan", "sequential", {"source": reg}, {"columns": ["doc_id"], "predicate": call("gt", field("n_chars"), lit(2000))}).visible()



@query("q_stream_batches", "SELECT CAST(count(*) AS BIGINT) AS batches, CAST(sum(n) AS BIGINT) AS rows, max(n) AS largest FROM (SELECT o_orderkey, least(1000, (SELECT count(*) FROM orders) - 1000 * k) AS n FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k * 1000 < (SELECT count(*) FROM orders))")
def stream_batches(spark, sf_dir):
    """A stored result read again in Arrow batches of a thousand rows."""
    rows = scan(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"])
    out = op("stream_read", "arrow_batches", {"artifact": rows}, {"batch_size": 1000})
    sizes = [b.num_rows for b in out.notes["batches"]()]
    return spark.createDataFrame([(len(sizes), sum(sizes), max(sizes))], "batches long, rows long, largest long")


# --- applications ------------------------------------------------------------------------------
def _apps(spark, sf_dir):
    from loomwork.operators.apps import Applications, ledger

    requests = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("member"), F.col("o_totalprice").alias("amount"))
    return Applications(spark, {"name": "member 7", "member": "7"}, {"ledger": ledger(requests)})


query("q_profile", _values("('member', '7'), ('name', 'member 7')", "name, value"))(lambda s, d: _apps(s, d).profile())
query("q_list_apps", "SELECT 'ledger' AS app, unnest(['create_payment_request', 'show_payment_requests', 'totals']) AS call")(lambda s, d: _apps(s, d).list_apps().select("app", F.explode("calls").alias("call")))
query("q_api_doc", "SELECT 'create_payment_request' AS call, unnest(['member', 'amount']) AS parameter, true AS changes")(lambda s, d: _apps(s, d).api_doc("ledger", "create_payment_request").select("call", F.explode("parameters").alias("parameter"), "changes"))
query("q_app_read", "SELECT o_custkey AS member, o_totalprice AS amount FROM orders WHERE o_custkey = 7")(lambda s, d: _apps(s, d).app_call("ledger", "show_payment_requests", {"member": 7}))


@query("q_app_change", "SELECT o_custkey AS member, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) + CASE WHEN o_custkey = 7 THEN 12.50 ELSE 0 END AS DOUBLE) AS amount FROM orders GROUP BY o_custkey")
def app_change(spark, sf_dir):
    """A request whose reply is lost is made once: the same key again changes nothing."""
    from loomwork.operators.apps import ReplyLost

    apps = _apps(spark, sf_dir)
    apps.lose_replies = 1
    for _ in range(3):
        try:
            apps.app_call("ledger", "create_payment_request", {"member": 7, "amount": 12.5}, key="k1")
        except ReplyLost:
            continue
    return apps.app_call("ledger", "totals", {})
