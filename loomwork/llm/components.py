"""Connected components of a graph given by its edges, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, root) for every vertex of edges (a, b); root is the smallest id reachable.

    Every vertex points at the smallest vertex it has heard of. A round joins each edge's ends to
    their roots, proposes the smaller root to the larger one (so whole trees are hooked at once),
    and then points vertices at their root's root. Roots only fall, and an edge inside a tree is
    dropped, so few edges last for more than a few rounds. Tables are keyed by vertex and combined
    before they are shuffled; a hub vertex costs one row per edge, never a group in memory.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # first forest: every vertex points at its smallest neighbour, if that is smaller
    live = materialize(edges, "edges")
    ends = live.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(live.select(F.col("a").alias("id"), F.col("a").alias("root")))
    tree = materialize(ends.groupBy("id").agg(F.min("root").alias("root")), "tree")
    for _ in range(max_rounds):
        # flatten: root := root of the root, until nothing moves
        while True:
            up = tree.select(F.col("id").alias("root"), F.col("root").alias("higher"))
            moved = tree.join(up, "root", "left").select("id", F.coalesce("higher", "root").alias("root"), (F.col("higher") < F.col("root")).alias("moved"))
            new = materialize(moved, "tree")
            discard(tree)
            changed = new.where("moved").limit(1).count()
            tree = new
            if not changed:
                break
        tree = tree.select("id", "root")
        tree._loomwork_path = new._loomwork_path  # type: ignore[attr-defined]
        # edges between trees, as edges between roots
        left = live.join(tree.withColumnsRenamed({"id": "a", "root": "ra"}), "a").join(tree.withColumnsRenamed({"id": "b", "root": "rb"}), "b")
        cross = left.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        rest = materialize(cross, "edges")
        discard(live)
        live = rest
        if not live.limit(1).count():
            discard(live)
            return tree
        hook = live.groupBy("b").agg(F.min("a").alias("to"))
        new = materialize(tree.join(hook, tree["id"] == hook["b"], "left").select("id", F.coalesce("to", "root").alias("root")), "tree")
        discard(tree)
        tree = new
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
