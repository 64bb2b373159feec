"""The fourteen collection transforms over arrays built from orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import nested as N
from loomwork.queries.base import query, t


def baskets(spark, sf_dir):
    """(o, lines): the lines of each order, by number, as an array of structs."""
    line = F.struct(F.col("l_linenumber").alias("no"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"))
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list(line)).alias("v"))


_B = "SELECT l_orderkey AS o, list(struct_pack(no := l_linenumber, qty := l_quantity, flag := l_returnflag) ORDER BY l_linenumber, l_quantity, l_returnflag) AS v FROM lineitem GROUP BY l_orderkey"
def V():
    return F.col("v")



def _q(name: str, expr, sql: str) -> None:
    query(f"q_tf_{name}", f"SELECT o, {sql} AS r FROM ({_B})")(lambda s, d: baskets(s, d).select("o", expr().alias("r")))


_q("get", lambda: N.transform("get", V(), path=[0, "qty"]), "v[1].qty")
_q("filter", lambda: N.transform("project", N.transform("filter", V(), predicates=[{"path": ["qty"], "cmp": "ge", "value": 10}, {"path": ["flag"], "cmp": "in", "value": ["A", "R"]}]), fields=["no"]), "list_transform(list_filter(v, lambda x: x.qty >= 10 AND x.flag IN ('A', 'R')), lambda x: x.no)")
_q("project", lambda: N.transform("project", V(), fields=["qty"]), "list_transform(v, lambda x: x.qty)")
_q("project_object", lambda: F.to_json(N.transform("project", V(), fields={"a": ["no"]})), "to_json(list_transform(v, lambda x: struct_pack(a := x.no)))")
_q("unique", lambda: F.sort_array(N.transform("unique", N.transform("project", V(), fields=["flag"]))), "list_sort(list_distinct(list_transform(v, lambda x: x.flag)))")
_q("slice", lambda: N.transform("slice", N.transform("project", V(), fields=["no"]), start=1, stop=-1), "list_transform(v, lambda x: x.no)[2:greatest(len(v) - 1, 1)]")
_q("flatten", lambda: N.transform("flatten", F.transform(V(), lambda x: F.array(x["no"], x["no"]))), "flatten(list_transform(v, lambda x: [x.no, x.no]))")
_q("concat", lambda: N.transform("concat", inputs=[N.transform("project", V(), fields=["no"]), N.transform("project", V(), fields=["no"])]), "list_concat(list_transform(v, lambda x: x.no), list_transform(v, lambda x: x.no))")
_q("sum", lambda: N.transform("sum", V(), path=["qty"]), "list_sum(list_transform(v, lambda x: x.qty))")
_q("count", lambda: N.transform("count", V()), "len(v)")
_q("object", lambda: F.to_json(N.transform("object", fields={"n": F.size(V()), "o": F.col("o")})), "to_json(struct_pack(n := len(v), o := o))")

query("q_tf_sort", "SELECT l_orderkey AS o, list(l_linenumber ORDER BY l_returnflag DESC, l_quantity, l_linenumber, l_quantity) AS r FROM lineitem GROUP BY l_orderkey")(
    lambda s, d: baskets(s, d).select("o", N.transform("project", N.transform("sort", V(), keys=[{"path": ["flag"], "descending": True}, {"path": ["qty"]}]), fields=["no"]).alias("r"))
)
query("q_tf_group", "SELECT l_orderkey AS o, l_returnflag AS key, count(*) AS count, sum(l_quantity) AS sum FROM lineitem GROUP BY ALL")(lambda s, d: baskets(s, d).select("o", F.explode(N.transform("group", V(), key=["flag"], value=["qty"])).alias("g")).select("o", "g.*"))
query("q_tf_group_rows", "SELECT l_returnflag AS key, count(*) AS count, sum(l_quantity) AS sum FROM lineitem GROUP BY ALL")(lambda s, d: N.group_rows(t(s, d, "lineitem"), F.col("l_returnflag"), F.col("l_quantity")))
query("q_tf_parse", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")(lambda s, d: t(s, d, "events").select("event_id", N.transform("parse", F.col("props"), schema="struct<k:string>")["k"].alias("k")))
query("q_tf_rows", "SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders")(
    lambda s, d: t(s, d, "orders").select("o_orderkey", F.explode(N.transform("rows", F.struct(F.array(F.lit("status"), F.lit("priority")).alias("columns"), F.array(F.array("o_orderstatus", "o_orderpriority")).alias("rows")))).alias("m")).select("o_orderkey", F.col("m")["status"].alias("status"), F.col("m")["priority"].alias("priority"))
)
