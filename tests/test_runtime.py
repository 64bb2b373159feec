"""Workflow runtime, SQL surface, strict sources, analytics and metrics."""

import json

import duckdb
import pytest

from loomwork.functions import compare as C
from loomwork.functions import metrics as M
from loomwork.functions import traces as A
from loomwork.functions.canonical import canonical_json, table_digest
from loomwork.plans.types import TypeFault, record, scalar
from loomwork.plans.workflow import CANCELLED, COMPLETED, FAILED, PENDING, Node, Workflow, replay
from loomwork.queries import ORACLE_SQL, QUERIES
from loomwork.sources import sql_surface
from loomwork.sources.registry import read_json_lines, read_tree
from tests.conftest import SF
from tests.oracle import same_rows


def tools(spark):
    return {"table": lambda name: spark.read.parquet(f"{SF}/{name}.parquet"), "count": lambda rows: rows.count(), "add": lambda a, b: a + b, "fail": lambda: 1 / 0}


def test_workflow(spark):
    w = Workflow(spark, tools(spark), slots=2)
    w.edit([Node("n", "table", {"name": "nation"}), Node("r", "table", {"name": "region"}), Node("a", "count", {"rows": {"$ref": "n"}}), Node("b", "count", {"rows": {"$ref": "r"}}), Node("sum", "add", {"a": {"$ref": "a"}, "b": {"$ref": "b"}}), Node("bad", "fail", {}), Node("after", "add", {"a": {"$ref": "bad"}, "b": 1})])
    status = w.dispatch()
    assert w.results["sum"] == 30 and status["bad"] == FAILED and status["after"] == PENDING
    with pytest.raises(TypeFault):
        w.edit([Node("x", "add", {"a": {"$ref": "y"}, "b": 1}), Node("y", "add", {"a": {"$ref": "x"}, "b": 1})])
    assert "x" not in w.nodes  # all or nothing
    w.edit(cancel=["after"])
    assert w.nodes["after"].status == CANCELLED
    w.edit(revise={"sum": {"arguments": {"a": {"$ref": "a"}, "b": 100}}})
    assert w.nodes["sum"].revision == 2
    w.dispatch()
    assert w.results["sum"] == 125
    assert w.submit({"node": "n", "column": "n_name"}).count() == 25
    lineage = {r["artifact_id"]: r["input_refs"] for r in w.artifact_table().collect()}
    assert any(len(v) == 1 for v in lineage.values())
    assert w.event_table().where("kind = 'worker_failed'").count() == 1
    branch = Workflow.continuation(spark, tools(spark), w.checkpoint())
    branch.edit([Node("more", "add", {"a": {"$ref": "sum"}, "b": 1})])
    branch.dispatch()
    assert branch.results["more"] == 126
    assert branch.event_table().where("inherited and (monotonic_end > 0 or size(resource_delta) > 0)").count() == 0
    again = replay(spark, tools(spark), [{"add": [{"id": "n", "tool": "table", "arguments": {"name": "nation"}}]}, {"add": [{"id": "c", "tool": "count", "arguments": {"rows": {"$ref": "n"}}}]}])
    assert again.results["c"] == 25 and again.nodes["c"].status == COMPLETED


def test_sql_surface(spark):
    for name in ("orders", "customer"):
        spark.read.parquet(f"{SF}/{name}.parquet").createOrReplaceTempView(name)
    out = sql_surface.select(spark, "select o_orderkey from orders order by o_orderkey", ["orders"], limit=10)
    assert len(out["rows"]) == 10 and out["has_more"] and out["next_offset"] == 10 and out["tables"] == ["orders"]
    for bad in ("drop view orders", "create table x as select 1", "insert into orders select * from orders", "set a=1", "select reflect('java.lang.System', 'exit', 0)", "select * from customer"):
        with pytest.raises(Exception):
            sql_surface.select(spark, bad, ["orders"])
    assert "Physical Plan" in sql_surface.explain(spark, "select * from orders", ["orders"])


def test_json_lines(spark, tmp_path):
    row = record(id=scalar("Int64"), score=scalar("Float64"), ok=scalar("Bool"))
    good = [{"id": i, "score": i / 2, "ok": i % 2 == 0} for i in range(5)]

    def read(lines, **more):
        p = tmp_path / f"{len(list(tmp_path.iterdir()))}.jsonl"
        p.write_text("\n".join(lines) + "\n")
        return read_json_lines(spark, str(p), row, **more)

    assert read([json.dumps(g) for g in good], expected_rows=5).count() == 5
    for bad in ('{"id": 1, "score": 1.0}', '{"id": true, "score": 1.0, "ok": true}', '{"id": 1, "score": 1.0, "ok": true, "x": 1}', '{"id": 1.5, "score": 1.0, "ok": true}', "not json", '{"id": null, "score": 1.0, "ok": true}'):
        with pytest.raises(Exception):
            read([bad]).collect()
    with pytest.raises(TypeFault):
        read([json.dumps(good[0])], expected_rows=2)
    with pytest.raises(TypeFault):
        read([json.dumps(good[0])], sha256="0" * 64)


def test_source_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("one\ntwo")
    assert read_tree(spark, str(tmp_path)).collect()[0]["text"] == "one\ntwo"


def test_interval_union_and_reliability(spark):
    df = spark.createDataFrame([(0.0, 2.0), (1.0, 3.0), (5.0, 6.0)], "start double, end double")
    assert A.interval_union(df, []).first()["seconds"] == 4.0
    assert C.pass_k(3, 4, 2) == 0.5


def test_bootstrap_is_seeded(spark):
    df = spark.range(200).selectExpr("id % 20 as parent", "cast(id % 7 as double) as v", "'x' as g")
    a, b = (A.bootstrap(df, ["g"], "parent", "v", draws=200, seed=3).first() for _ in range(2))
    assert a == b and a["low"] <= a["mean"] <= a["high"]


def test_canonical_and_comparison(spark):
    assert canonical_json({"b": 1, "a": [None, True]}) == '{"a":[null,true],"b":1}'
    assert C.tolerant_equal_values([1.0, 2.0], [2.0001, 1.0]) and not C.tolerant_equal_values(1, True) and not C.canonical_equal(1, 1.0)
    df = spark.range(10).selectExpr("id", "id % 3 as k")
    assert table_digest(df).first() == table_digest(df.repartition(3)).first() != table_digest(df.where("id < 9")).first()


def test_metric_registry(spark):
    fields = spark.createDataFrame([("a", True, True, False, True, False, True), ("b", False, True, True, True, False, True), ("c", True, False, False, False, True, False)], "field string, ok boolean, changed boolean, stale boolean, support boolean, unsupported boolean, answered boolean")
    got = {r["metric"]: r for r in M.registry({"fields": fields}).collect()}
    assert len(got) == 48
    assert got["M17"]["value"] == 0.5 and got["M19"]["numerator"] == 1 and got["M18"]["value"] == 1.0 and got["M21"]["numerator"] == 2
    assert got["M04"]["status"] == "NOT_OBSERVED" and got["M04"]["value"] is None
    spans = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("c", 1.0)], "task_id string, seconds double")
    edges = spark.createDataFrame([("c", "a"), ("c", "b")], "task_id string, needs string")
    assert M.critical_path(spans, edges).first()["seconds"] == 4.0


def test_stream_pairing(spark, tmp_path):
    from loomwork.streaming.events import pair_starts_and_ends, read_log, run_to_end

    rows = [("x", 1.0, "worker_started"), ("x", 2.0, "worker_finished"), ("y", 1.5, "worker_started"), ("x", 3.0, "worker_started"), ("x", 4.5, "worker_failed")]
    spark.createDataFrame(rows, "task_id string, t double, kind string").coalesce(1).write.json(str(tmp_path / "log"))
    out = run_to_end(pair_starts_and_ends(read_log(spark, str(tmp_path / "log"), "task_id string, t double, kind string")), "pairs")
    assert sorted(tuple(r) for r in out.collect()) == [("x", 1.0, 2.0, "worker_finished"), ("x", 3.0, 4.5, "worker_failed")]


def test_faults_and_recovery(spark):
    from loomwork.plans.workflow import Faults

    state: dict[str, int] = {}
    read = Faults(lambda: len(state), fail_first=1)
    write = Faults(lambda key, amount: state.update({key: amount}), lose_reply=1)
    w = Workflow(spark, {"read": read, "write": write})
    w.edit([Node("r", "read", {}), Node("p", "write", {"key": "a", "amount": 5})])
    assert w.dispatch() == {"r": FAILED, "p": FAILED}
    assert set(w.latest_failures()) == {"r", "p"} and state == {"a": 5}  # the reply was lost, not the write
    w.edit(revise={"r": {"arguments": {}}, "p": {"arguments": {"key": "a", "amount": 5}}})
    assert set(w.dispatch().values()) == {COMPLETED} and state == {"a": 5} and w.results["r"] in (0, 1)


def test_shapes_and_symbols():
    from loomwork.functions import metrology as Y

    assert Y.normalize_shape([[["a", 1], ["b", 2]]], ["k", "v"]) == [["a", 1], ["b", 2]]
    assert Y.normalize_shape({"a": 1, "b": 2}, ["k", "v"]) == [["a", 1], ["b", 2]]
    assert Y.normalize_shape({"k": "a", "v": 1}, ["k", "v"]) == [["a", 1]]
    assert Y.normalize_shape(["a", 1], ["k", "v"]) == [["a", 1]]
    assert Y.contains({"x": [{"a": 1, "b": 2}]}, {"a": 1}) and not Y.contains({"a": True}, {"a": 1})
    assert Y.symbol("`pkg/mod.py::Class.method(x)`") == "pkg.mod.py.Class.method"


def test_equal_results(spark):
    from loomwork.functions import metrology as Y

    a = spark.range(5).selectExpr("id as Customer_ID", "id * 2 as total")
    assert Y.equal_results(a, a.selectExpr("total", "Customer_ID as customerid"))
    assert not Y.equal_results(a, a.limit(4).selectExpr("total", "Customer_ID as customerid"))


@pytest.mark.parametrize("keys", [[300_000 >> i for i in range(19)], [1, 2, 5, 900_001], [7, 2**40 + 12_345], [3], [-4, 0]])
def test_loop_plan_of_any_key(spark, tmp_path, keys):
    """More than 16 halvings, keys between which no customer has one, and none to halve."""
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    want = max(keys)
    while want > 3:
        want //= 2
    assert [tuple(r) for r in QUERIES["q_loop_plan"](spark, str(tmp_path)).collect()] == [(want,)]


def test_probe_inputs_of_pages_that_share_a_url(spark, tmp_path):
    """Only the labelled page of two with one url is read, each of two labelled ones is, and a
    page without a url is one too."""
    pages = [(1, "u", "a"), (2, "u", "b"), (3, "v", "c"), (4, "v", "c"), (5, None, "d"), (6, "w", "e")]
    labels = [(1, 1), (1, 1), (2, 0), (3, 1), (4, 1), (5, 1), (6, None), (None, 1)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    same_rows(QUERIES["q_probe_inputs"](spark, str(tmp_path)), con.sql(ORACLE_SQL["q_probe_inputs"]))
