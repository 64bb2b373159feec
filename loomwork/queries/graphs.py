"""Graph queries. Edges: who (customer) bought from which nation of suppliers; papers and authors
are stood for by orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import graph as G
from loomwork.operators.base import GraphData, Value
from loomwork.plans.predicates import call, field, lit
from loomwork.plans.types import Type, scalar
from loomwork.queries.base import op, query, t

I, D, S = scalar("Int64"), scalar("Float64"), scalar("Utf8")

#: A directed graph of all customers: each points at two others, by arithmetic on its key.
EDGES = """
SELECT c_custkey AS source, (c_custkey * 7 + 3) % m AS target, CAST(1 + c_custkey % 5 AS DOUBLE) AS weight, CASE WHEN c_custkey % 3 = 0 THEN 'cites' ELSE 'knows' END AS relation FROM customer, (SELECT max(c_custkey) + 1 AS m FROM customer)
UNION ALL
SELECT c_custkey, (c_custkey * c_custkey + 1) % m, CAST(2 + c_custkey % 3 AS DOUBLE), 'likes' FROM customer, (SELECT max(c_custkey) + 1 AS m FROM customer)"""


def customers(spark, sf_dir) -> Value:
    c = t(spark, sf_dir, "customer")
    k, m = F.col("c_custkey"), c.agg(F.max("c_custkey") + 1).scalar()
    one = c.select(k.alias("source"), ((k * 7 + 3) % m).alias("target"), (1 + k % 5).cast("double").alias("weight"), F.when(k % 3 == 0, "cites").otherwise("knows").alias("relation"))
    two = c.select(k.alias("source"), ((k * k + 1) % m).alias("target"), (2 + k % 3).cast("double").alias("weight"), F.lit("likes").alias("relation"))
    meta = {"node_id_type": I, "node_schema": {"name": S}, "edge_types": ["cites", "knows", "likes"], "weight_nonnegative": True}
    return Value(GraphData(c.select(k.alias("id"), F.col("c_mktsegment").alias("name")), one.unionByName(two)), Type("Graph", schema=(("source", I), ("target", I), ("weight", D), ("relation", S)), domain="customers", revision="1", metadata=meta))


def seeds(graph: Value, condition: str) -> Value:
    return Value(graph.data.nodes.where(condition).select("id"), Type("NodeSet", item=I, domain="customers", revision="1"))


def _neighbors(spark, sf_dir, implementation, direction, kinds=()):
    g = customers(spark, sf_dir)
    return op("graph_neighbors", implementation, {"graph": g, "seeds": seeds(g, "name = 'BUILDING'")}, {"direction": direction, "edge_types": list(kinds)}).df


_E = f"WITH e AS ({EDGES})"
_SEEDS = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"
query("q_graph_neighbors_csr", f"{_E} SELECT * FROM e WHERE source IN ({_SEEDS})")(lambda s, d: _neighbors(s, d, "csr", "out"))
query("q_graph_neighbors_adjacency", f"{_E} SELECT * FROM e WHERE target IN ({_SEEDS}) AND relation IN ('cites', 'likes')")(lambda s, d: _neighbors(s, d, "indexed_adjacency", "in", ("cites", "likes")))
query("q_graph_neighbors_both", f"{_E} SELECT * FROM e WHERE source IN ({_SEEDS}) OR target IN ({_SEEDS})")(lambda s, d: _neighbors(s, d, "csr", "both"))


def _reach(spark, sf_dir, implementation, direction):
    g = customers(spark, sf_dir)
    return op("graph_reachability", implementation, {"graph": g, "seeds": seeds(g, "id in (1, 2)")}, {"direction": direction, "max_hops": 3}).df


_STEPS = {"out": "SELECT source AS a, target AS b FROM e", "both": "SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e"}
for _impl, _dir in (("bfs", "out"), ("dfs", "both")):
    query(f"q_reachability_{_impl}", f"WITH RECURSIVE e AS ({EDGES}), st AS ({_STEPS[_dir]}), r(id, h) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey IN (1, 2) UNION SELECT st.b, r.h + 1 FROM r JOIN st ON st.a = r.id WHERE r.h < 3) SELECT DISTINCT id FROM r")(lambda s, d, i=_impl, x=_dir: _reach(s, d, i, x))


def _paths(spark, sf_dir, implementation, weight):
    g = customers(spark, sf_dir)
    params = {"target": [10, 500, 731]} | ({"weight_field": "weight"} if weight else {})
    return op("graph_shortest_path", implementation, {"graph": g, "seeds": seeds(g, "id = 1")}, params).df.select("source", "target", "cost")


#: Breadth first by levels, and relaxation by rounds, both bounded.
query("q_shortest_path_bfs", f"WITH RECURSIVE e AS ({EDGES}), r(id, h) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.target, r.h + 1 FROM r JOIN e ON e.source = r.id WHERE r.h < 40) SELECT CAST(1 AS BIGINT) AS source, x.id AS target, CAST(min(r.h) AS DOUBLE) AS cost FROM (VALUES (10::BIGINT), (500::BIGINT), (731::BIGINT)) x(id) LEFT JOIN r ON r.id = x.id GROUP BY x.id")(lambda s, d: _paths(s, d, "bfs", False))
query("q_shortest_path_dijkstra", f"WITH RECURSIVE e AS ({EDGES}), r(id, c) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS DOUBLE) UNION SELECT e.target, r.c + e.weight FROM r JOIN e ON e.source = r.id WHERE r.c + e.weight <= 80) SELECT CAST(1 AS BIGINT) AS source, x.id AS target, min(r.c) AS cost FROM (VALUES (10::BIGINT), (500::BIGINT), (731::BIGINT)) x(id) LEFT JOIN r ON r.id = x.id GROUP BY x.id")(lambda s, d: _paths(s, d, "dijkstra", True))

query("q_graph_filter_edge_mask", f"{_E} SELECT * FROM e WHERE weight > 3")(lambda s, d: op("graph_filter", "edge_mask", {"graph": customers(s, d)}, {"predicate": call("gt", field("edge.weight"), lit(3.0))}).data.edges)
query("q_graph_filter_node", f"{_E} SELECT e.* FROM e JOIN customer a ON e.source = a.c_custkey JOIN customer b ON e.target = b.c_custkey WHERE a.c_mktsegment = 'BUILDING' AND b.c_mktsegment = 'BUILDING' AND weight > 2")(
    lambda s, d: op("graph_filter", "index_filter", {"graph": customers(s, d)}, {"predicate": call("and", call("eq", field("node.name"), lit("BUILDING")), call("gt", field("weight"), lit(2.0)))}).data.edges
)


@query("q_subgraph_induced", f"{_E} SELECT * FROM e WHERE source IN ({_SEEDS}) AND target IN ({_SEEDS})")
def induced(spark, sf_dir):
    g = customers(spark, sf_dir)
    return op("graph_subgraph", "induced", {"graph": g, "nodes": seeds(g, "name = 'BUILDING'")}, {"mode": "induced"}).data.edges


@query("q_subgraph_edges", f"{_E} SELECT DISTINCT c_custkey AS id, c_mktsegment AS name FROM customer WHERE c_custkey IN (SELECT source FROM e WHERE weight > 4 UNION SELECT target FROM e WHERE weight > 4)")
def edge_selected(spark, sf_dir):
    g = customers(spark, sf_dir)
    chosen = Value(g.data.edges.where("weight > 4"), Type("EdgeStream", schema=g.type.schema, domain="customers", revision="1"))
    return op("graph_subgraph", "edge_selected", {"graph": g, "edges": chosen}, {"mode": "edge_selected"}).data.nodes


# --- graph store -----------------------------------------------------------------------------
def papers(spark, sf_dir):
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.floor("o_totalprice").alias("citations"))


def authorship(spark, sf_dir):
    return t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("author"), F.col("o_orderkey").alias("paper"))


query("q_search_nodes", "SELECT p_partkey AS id, p_name AS name FROM part WHERE lower(p_name) LIKE '%an%'")(lambda s, d: G.search_nodes(t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "An"))
query("q_nodes", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey IN (3, 5, 8)")(lambda s, d: G.nodes_by_id(t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), [3, 5, 8]))


@query("q_references", "SELECT o_orderkey AS id, coalesce(list_sort(list_distinct(list(l_partkey) FILTER (l_partkey IS NOT NULL))), []) AS refs FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'A') ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def references(spark, sf_dir):
    edges = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("type"))
    return G.references(edges, papers(spark, sf_dir))


@query("q_publication_summary", "WITH p AS (SELECT o_custkey AS author, o_orderkey AS paper, CAST(floor(o_totalprice) AS BIGINT) AS c FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996) SELECT c_custkey AS author, count(paper) AS papers, CAST(coalesce(sum(c), 0) AS BIGINT) AS citations, first(paper ORDER BY c DESC, paper) AS top_paper, first(c ORDER BY c DESC, paper) AS top_citations FROM customer LEFT JOIN p ON c_custkey = author GROUP BY c_custkey")
def publication_summary(spark, sf_dir):
    authors = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("author"))
    return G.publication_summary(authorship(spark, sf_dir), papers(spark, sf_dir), authors, (1994, 1996))


@query("q_dossier", "SELECT DISTINCT n_name FROM lineitem a JOIN orders o ON a.l_orderkey = o.o_orderkey JOIN lineitem b ON a.l_partkey = b.l_partkey JOIN orders p ON b.l_orderkey = p.o_orderkey JOIN customer c ON p.o_custkey = c.c_custkey JOIN nation ON c.c_nationkey = n_nationkey WHERE o.o_custkey = 10 AND p.o_custkey <> 10")
def dossier(spark, sf_dir):
    """Nations of those who bought a part that customer 10 bought."""
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    links = rows.select(F.col("o_custkey").alias("author"), F.col("l_partkey").alias("paper")).distinct()
    others = G.coauthors(links, 10)
    c, n = t(spark, sf_dir, "customer"), t(spark, sf_dir, "nation")
    return others.join(c, F.col("author") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name").distinct()


@query("q_lineage_closure", "WITH RECURSIVE r(id) AS (SELECT max(c_custkey) FROM customer UNION SELECT CAST(floor(id / 2) AS BIGINT) FROM r WHERE id > 0) SELECT id FROM r")
def lineage(spark, sf_dir):
    """Each artifact comes from that of half its number; the closure of the last one."""
    c = t(spark, sf_dir, "customer")
    edges = c.where("c_custkey >= 1").select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 2).alias("parent"))
    return G.ancestors(edges, c.agg(F.max("c_custkey").alias("id")))
