"""Graph operators over node and edge tables. Traversal is a bounded sequence of joins, each level
written to the shared folder so that plans and lineage stay short."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.base import ORD, GraphData, Value, implements, one_of, take, whole
from loomwork.plans.predicates import analyze, fields_of
from loomwork.plans.types import Type, TypeFault, scalar
from loomwork.sources.storage import store

MAX_HOPS = 4096
PATIENCE = 8  # rounds of a path search before its targets are looked at from their end


def _check_ids(graph: Value, ids: Value) -> None:
    if (graph.type.domain, graph.type.revision) != (ids.type.domain, ids.type.revision):
        raise TypeFault("DOMAIN_MISMATCH graph and nodes")


def _chosen(g: GraphData, params: dict) -> DataFrame:
    """Edges of the wanted types; an empty list means all."""
    kinds = params.get("edge_types") or []
    return g.edges.where(F.col(g.relation).isin(kinds)) if kinds else g.edges


def _ids(df: DataFrame) -> DataFrame:
    return df.drop(ORD).toDF("id").where("id is not null").distinct()


def arcs(g: GraphData, edges: DataFrame, direction: str, weight: str | None = None) -> DataFrame:
    """(a, b, w): the steps that a direction allows."""
    w = F.col(weight) if weight else F.lit(1.0)
    out = edges.select(F.col(g.source).alias("a"), F.col(g.target).alias("b"), w.alias("w"))
    back = edges.select(F.col(g.target).alias("a"), F.col(g.source).alias("b"), w.alias("w"))
    return {"out": out, "in": back, "both": out.union(back)}[direction]


@implements("graph_neighbors", "csr", "indexed_adjacency")
def neighbors(inputs: dict, params: dict, name: str) -> dict:
    """Edges incident to the seeds; with both, an edge between two seeds is returned once."""
    take(params, {"direction": str}, {"edge_types": list})
    graph, seeds = inputs["graph"], inputs["seeds"]
    direction = one_of(params, "direction", {"in", "out", "both"})
    _check_ids(graph, seeds)
    known = graph.type.metadata.get("edge_types")
    if known is not None and set(params.get("edge_types") or []) - set(known):
        raise TypeFault("PARAMETER_ENUM edge_types")
    g, edges, ids = graph.data, _chosen(graph.data, params), _ids(seeds.df)
    if direction == "both":
        from_a = edges.join(ids, edges[g.source] == ids["id"], "left_semi")
        rest = edges.join(ids, edges[g.source] == ids["id"], "left_anti")
        df = from_a.unionByName(rest.join(ids, rest[g.target] == ids["id"], "left_semi"))
    else:
        df = edges.join(ids, edges[g.source if direction == "out" else g.target] == ids["id"], "left_semi")
    return {"edges": Value(df, Type("EdgeStream", schema=graph.type.schema, domain=graph.type.domain, revision=graph.type.revision))}


def reach(steps: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(id, depth) of all nodes within max_hops steps, the seeds at depth 0."""
    level = store(seeds.select("id", F.lit(0).alias("depth")), "level")
    levels, seen, held = [level], level.select("id"), 1
    pairs = store(steps.select("a", "b").distinct(), "steps")
    for hop in range(1, max_hops + 1):
        after = level.join(pairs, level["id"] == pairs["a"]).select(F.col("b").alias("id")).distinct()
        level = store(after.join(seen, "id", "left_anti").select("id", F.lit(hop).alias("depth")), "level")
        if level.isEmpty():
            break
        levels.append(level)
        # the visited nodes are rewritten whenever the number of levels has doubled, so that each
        # is read and written a logarithmic number of times
        seen = seen.unionByName(level.select("id"))
        if len(levels) >= 2 * held:
            seen, held = store(seen, "seen"), len(levels)
    return reduce(DataFrame.unionByName, levels)


@implements("graph_reachability", "bfs", "dfs")
def reachability(inputs: dict, params: dict, name: str) -> dict:
    take(params, {"direction": str, "max_hops": int}, {"edge_types": list})
    graph, seeds = inputs["graph"], inputs["seeds"]
    direction = one_of(params, "direction", {"in", "out", "both"})
    hops = whole(params, "max_hops", 0, MAX_HOPS)
    _check_ids(graph, seeds)
    found = reach(arcs(graph.data, _chosen(graph.data, params), direction), _ids(seeds.df), hops)
    return {"nodes": Value(found.select("id"), replace(seeds.type, kind="NodeSet"))}


def chains(steps: DataFrame, keep: DataFrame) -> DataFrame:
    """(id, up, done) of the nodes that one other node alone leads to and that are not to be kept:
    every path to them comes through up. By pointer doubling up is the nearest node above that is
    no such node; where done is false there is none, and the chain comes out of a closed cycle."""
    single = steps.groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("up")).where("n = 1").drop("n")
    ways = store(single.join(keep, "id", "left_anti"), "ways")
    tops = ways.select(F.col("id").alias("up"), F.lit(True).alias("inner"))
    ways, open_before = store(ways.join(tops, "up", "left").select("id", "up", F.col("inner").isNull().alias("done")), "ways"), None
    while (still := ways.where("not done").count()) and still != open_before:
        # a chain has a node at every distance from its top: when no node between the distance
        # reached and twice that ends, none further away does
        above = ways.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("done").alias("ends"))
        moved = ways.where("not done").join(above, "up").select("id", F.col("further").alias("up"), F.col("ends").alias("done"))
        ways, open_before = store(ways.where("done").unionByName(moved), "ways"), still
    return ways


def reachable_targets(steps: DataFrame, seeds: DataFrame, missing: list):
    """Searches back from the missing targets, a hop for each next(): None while there is more to
    see, at last (source, reach), how many of them each seed leads to. Chains are one hop."""
    ways = chains(steps, seeds)

    def lifted(df: DataFrame, column: str) -> DataFrame:
        tops = ways.select(F.col("id").alias(column), "up", "done")
        return df.join(tops, column, "left").where("done is null or done").withColumn(column, F.coalesce("up", column)).drop("up", "done")

    back = store(lifted(steps.select("a", "b").join(ways, F.col("b") == F.col("id"), "left_anti"), "a").distinct(), "back")
    wanted = F.explode(F.array(*[F.lit(x).cast(seeds.schema["id"].dataType) for x in missing]))  # the plan's own list
    level = store(lifted(seeds.limit(1).select(wanted.alias("id")).withColumn("target", F.col("id")), "id").select("target", "id"), "level")
    seen, levels, held = level, 1, 1
    while not level.isEmpty():
        yield None
        after = level.join(back, level["id"] == back["b"]).select("target", F.col("a").alias("id")).distinct()
        level = store(after.join(seen, ["target", "id"], "left_anti"), "level")
        seen, levels = seen.unionByName(level), levels + 1
        if levels >= 2 * held:  # as in reach
            seen, held = store(seen, "seen"), levels
    yield store(seeds.join(seen, "id").groupBy(F.col("id").alias("source")).agg(F.count(F.lit(1)).alias("reach")), "reach")


def shortest_paths(steps: DataFrame, seeds: DataFrame, targets: list | None = None, max_rounds: int | None = None) -> DataFrame:
    """(source, target, cost, path): the cheapest path from each seed to each node it reaches, ties
    by the lexicographically smallest path. Each round extends only what became cheaper and, once
    all targets that a source reaches have a path, what is no dearer than the dearest of those:
    weights are not negative, so nothing else can improve them. Targets that are far or out of
    reach are also searched from their end, in step, which ends first where few nodes or chains
    alone lead to them. Paths hold no node twice, so the rounds end by themselves."""
    start = [F.col("id").alias("source"), F.col("id").alias("target"), F.lit(0.0).alias("cost"), F.array("id").alias("path"), F.lit(True).alias("changed")]
    best = store(seeds.select(*start), "paths")
    seeds = best.select(F.col("source").alias("id"))
    steps = store(steps.where("a <> b").groupBy("a", "b").agg(F.min("w").alias("w")), "steps")
    label, fresh, known = F.struct("cost", "path"), F.col("new"), F.col("old")
    targets = list(dict.fromkeys(targets or []))
    back, known_reach, missing = None, None, []
    for turn in count() if max_rounds is None else range(max_rounds):
        front = best.where("changed")
        if targets:
            at = best.where(F.col("target").isin(targets))
            if turn == PATIENCE:
                sources, have = seeds.count(), {r["target"]: r["count"] for r in at.groupBy("target").count().collect()}
                missing = [x for x in targets if have.get(x, 0) < sources]
                back = reachable_targets(steps, seeds, missing) if missing else None
            if back and known_reach is None:
                known_reach = next(back)
            found = at.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("cost").alias("bound"))
            goal = seeds.select(F.col("id").alias("source")).join(found, "source", "left")
            if known_reach is None:
                goal = goal.withColumn("wanted", F.lit(len(targets)))
            else:
                goal = goal.join(known_reach, "source", "left").withColumn("wanted", len(targets) - len(missing) + F.coalesce("reach", F.lit(0))).drop("reach")
            goal = goal.where(F.coalesce("n", F.lit(0)) >= F.col("wanted")).select("source", F.when(F.col("n").isNull(), -1.0).otherwise(F.col("bound")).alias("bound"))
            front = front.join(goal, "source", "left").where("bound is null or cost <= bound").drop("bound")
        longer = front.join(steps, front["target"] == steps["a"]).where(~F.array_contains("path", F.col("b")))
        longer = longer.select("source", F.col("b").alias("target"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("b")).alias("path"))
        offers = longer.groupBy("source", "target").agg(F.min(label).alias("new"))
        both = best.select("source", "target", label.alias("old")).join(offers, ["source", "target"], "full")
        better = known.isNull() | F.coalesce(fresh < known, F.lit(False))
        merged = both.select("source", "target", F.when(better, fresh).otherwise(known).alias("l"), better.alias("changed"))
        best = store(merged.select("source", "target", "l.*", "changed"), "paths")
        if best.where("changed").isEmpty():
            return best.drop("changed")
    raise RuntimeError("paths have not settled")


@implements("graph_shortest_path", "bfs", "dijkstra")
def shortest_path(inputs: dict, params: dict, name: str) -> dict:
    """bfs needs equal weights, dijkstra weights that are not negative; where the type does not
    say, the data are checked first. An unreachable target has a null cost and path."""
    take(params, {"target": (int, str, list)}, {"weight_field": str, "direction": str, "edge_types": list})
    graph, seeds = inputs["graph"], inputs["seeds"]
    _check_ids(graph, seeds)
    targets = params["target"] if isinstance(params["target"], list) else [params["target"]]
    want = int if seeds.type.item and seeds.type.item.kind == "Int64" else str
    if not targets or not all(type(t) is want for t in targets):
        raise TypeFault("TYPE_MISMATCH target")
    g, weight = graph.data, params.get("weight_field")
    edges = _chosen(g, params)
    if weight:
        facts = graph.type.metadata
        if facts.get("weight_equal") is not True if name == "bfs" else facts.get("weight_nonnegative") is not True:
            lo, hi, bad = edges.agg(F.min(weight), F.max(weight), F.count_if(F.col(weight).isNull() | F.isnan(F.col(weight).cast("double")))).first()
            if bad or (lo is not None and (lo < 0 or (name == "bfs" and lo != hi))):
                raise TypeFault("WEIGHT_DOMAIN_CHECK")
    ids = _ids(seeds.df)
    found = shortest_paths(arcs(g, edges, params.get("direction", "out"), weight), ids, list(dict.fromkeys(targets)))
    kind = ids.schema["id"].dataType
    wanted = F.explode(F.array(*[F.lit(x).cast(kind) for x in dict.fromkeys(targets)])).alias("target")  # the plan's own list
    asked = ids.select(F.col("id").alias("source"), wanted)
    df = asked.join(found, ["source", "target"], "left")
    return {"paths": Value(df, Type("PathSet", item=seeds.type.item, domain=graph.type.domain, revision=graph.type.revision))}


@implements("graph_filter", "edge_mask", "index_filter")
def graph_filter(inputs: dict, params: dict, name: str) -> dict:
    """Edges for which the predicate is true. Plain and edge.* names are edge columns; node.* must
    hold for both ends."""
    take(params, {"predicate": dict})
    graph = inputs["graph"]
    g, node_schema = graph.data, dict(graph.type.metadata.get("node_schema", {}))
    edge = [(n, t) for n, t in graph.type.schema] + [(f"edge.{n}", t) for n, t in graph.type.schema]

    def kept(prefix: str) -> DataFrame:
        end = g.source if prefix == "source" else g.target
        nodes = g.nodes.select(*[F.col(n).alias(f"node.{n}") for n in g.nodes.columns])
        rows = edges_plus.join(nodes, F.col(f"`{end}`") == F.col("`node.id`"))
        row = Type("Record", schema=(*edge, *((f"node.{n}", t) for n, t in node_schema.items()), ("node.id", graph.type.metadata.get("node_id_type", scalar("Int64")))))
        return rows.where(analyze(params["predicate"], row).column()).select("__edge")

    if any(n.startswith("node.") for n in fields_of(params["predicate"])):
        edges = store(g.edges.withColumn("__edge", F.monotonically_increasing_id()), "edges")
        edges_plus = edges.select("*", *[F.col(n).alias(f"edge.{n}") for n, _ in graph.type.schema])
        df = edges.join(kept("source"), "__edge", "left_semi").join(kept("target"), "__edge", "left_semi").drop("__edge")
    else:
        e = analyze(params["predicate"], Type("Record", schema=tuple(edge)))
        if e.type.base.kind != "Bool":
            raise TypeFault("TYPE_MISMATCH a predicate is Bool")
        edges_plus = g.edges.select("*", *[F.col(n).alias(f"edge.{n}") for n, _ in graph.type.schema])
        df = edges_plus.where(e.column()).select(g.edges.columns)
    return {"graph": Value(replace(g, edges=df), replace(graph.type, kind="GraphView"))}


@implements("graph_subgraph", "induced", "edge_selected")
def subgraph(inputs: dict, params: dict, name: str) -> dict:
    """induced: the given nodes and all edges with both ends among them; edge_selected: the given
    edges and their ends."""
    take(params, {"mode": str})
    if params["mode"] != name:
        raise TypeFault("PARAMETER_ENUM mode")
    graph = inputs["graph"]
    g = graph.data
    if name == "induced":
        _check_ids(graph, inputs["nodes"])
        ids = _ids(inputs["nodes"].df)
        edges = g.edges.join(ids, g.edges[g.source] == ids["id"], "left_semi")
        edges = edges.join(ids, edges[g.target] == ids["id"], "left_semi")
    else:
        _check_ids(graph, inputs["edges"])
        edges = inputs["edges"].df
        ids = edges.select(F.explode(F.array(g.source, g.target)).alias("id")).distinct()
    return {"graph": Value(replace(g, nodes=g.nodes.join(ids, "id", "left_semi"), edges=edges), replace(graph.type, kind="Graph"))}


# --- graph store queries -------------------------------------------------------------------------
def search_nodes(nodes: DataFrame, text: str, kind: int | None = None) -> DataFrame:
    """Case-insensitive LIKE %text%, where % and _ in text are wildcards and nothing escapes."""
    pattern = f"%{text.lower()}%".replace("\\", "\\\\")
    found = nodes.where(F.lower("name").like(pattern))
    return found if kind is None else found.where(F.col("type") == kind)


def nodes_by_id(nodes: DataFrame, ids: list) -> DataFrame:
    if len(ids) > 100 or len(set(ids)) != len(ids):
        raise TypeFault("PARAMETER_RANGE up to 100 distinct ids")
    return nodes.where(F.col("id").isin(ids))


def references(edges: DataFrame, papers: DataFrame, kind: int = 1) -> DataFrame:
    """(id, refs): sorted distinct targets of each paper's edges of a kind; every paper appears."""
    refs = edges.where(F.col("type") == kind).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("refs"))
    empty = F.array().cast(refs.schema["refs"].dataType)
    return papers.select("id").distinct().join(refs, "id", "left").select("id", F.coalesce("refs", empty).alias("refs"))


def publication_summary(authorship: DataFrame, papers: DataFrame, authors: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """Per author: papers, total citations, and the most cited one (ties: smallest id). Authors
    without papers have zeros and nulls."""
    p = papers.select(F.col("id").alias("paper"), F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("year", F.lit(-1)).alias("year"))
    if years:
        p = p.where(F.col("year").between(*years))
    rows = authorship.select("author", "paper").join(p, "paper")
    best = F.max_by(F.struct("paper", "citations"), F.struct(F.col("citations"), (-F.col("paper")).alias("neg")))
    found = rows.groupBy("author").agg(F.count(F.lit(1)).alias("papers"), F.sum("citations").alias("citations"), best.alias("top"))
    out = authors.select("author").distinct().join(found, "author", "left")
    return out.select("author", F.coalesce("papers", F.lit(0)).alias("papers"), F.coalesce("citations", F.lit(0)).alias("citations"), F.col("top.paper").alias("top_paper"), F.col("top.citations").alias("top_citations"))


def coauthors(authorship: DataFrame, author) -> DataFrame:
    mine = authorship.where(F.col("author") == author).select("paper")
    return authorship.join(mine, "paper", "left_semi").where(F.col("author") != author).select("author").distinct()


def ancestors(edges: DataFrame, starts: DataFrame, child: str = "child", parent: str = "parent", max_hops: int = 256) -> DataFrame:
    """The lineage closure: all that the starts come from, themselves included."""
    steps = edges.select(F.col(child).alias("a"), F.col(parent).alias("b"))
    return reach(steps, starts.toDF("id").distinct(), max_hops).select("id")


def publication_records(authorship: DataFrame, papers: DataFrame, years: tuple[int, int]) -> DataFrame:
    """(author, paper, year, citations) of the papers of a window of years."""
    p = papers.where(F.col("year").between(*years)).select(F.col("id").alias("paper"), "year", "citations")
    return authorship.select("author", "paper").join(p, "paper").select("author", "paper", "year", "citations")


def top_paper_references(authorship: DataFrame, papers: DataFrame, edges: DataFrame, years: tuple[int, int]) -> DataFrame:
    """(author, paper, refs): each author's most cited paper of the window (ties: smallest id) and
    the papers it refers to."""
    rows = publication_records(authorship, papers, years)
    top = rows.groupBy("author").agg(F.max_by("paper", F.struct(F.coalesce("citations", F.lit(0)).alias("c"), (-F.col("paper")).alias("neg"))).alias("paper"))
    refs = references(edges, top.select(F.col("paper").alias("id")))
    return top.join(refs, top["paper"] == refs["id"]).select("author", "paper", "refs")
