"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, representatives.

Equal vectors form a class and go on as one. Centroids are fitted on a bounded sample; every
vector is owned by the cell of its nearest centroid and visits each cell whose centroid is nearly
as near: its cosine is less than the nearest one's by at most a margin. A pair is found if either
of the two visits the other's cell. The margin is calibrated on the sample: partners are drawn at
exactly the threshold, in directions at random, which is the hardest case, and the margin is the
least that finds RECALL of them; pairs that are nearer than the threshold are found more often, and
with one cell all are. (No exact bound prunes vectors in many dimensions: any two cells can hold
such a pair.) A pair that both of its vectors would find is counted for each by its own visit; else
the one visit counts for both, so n_links is symmetric.

A cell's owners and guests are dealt into blocks of about BLOCK_ROWS; a task multiplies one block of
guests with one of owners. It returns, per vector, how many vectors it links with, and the
components within the block (a label per vector instead of pairs), so results stay linear even
where all vectors of a cell are alike. Vectors of a dimension other than the sample's most common
one share a cell with all others of that dimension.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link
with nothing and are kept; so do rows with a null vec_id, whose component is null; repeated rows
count as vectors of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import bounded_batches, bounded_sample, keep_id, map_batches, materialize, released
from loomwork.llm.components import connected_components

THRESHOLD = 0.9
SAMPLE_ROWS = 20_000
CELL_ROWS, MAX_CELLS = 4096, 4096
BLOCK_ROWS = 4096
#: Rows of a product at a time.
SLICE = 512
#: Share of pairs at the threshold that the margin must find, and partners drawn to calibrate it.
RECALL, DRAWS = 0.999, 8000
ROUNDS = 12


def spherical_kmeans(unit: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids; an empty cell restarts at the vector least like its own centroid."""
    rng = np.random.default_rng(seed)
    centroids = unit[rng.choice(len(unit), min(k, len(unit)), replace=False)]
    for _ in range(rounds):
        own, best = np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for at in range(0, len(unit), SLICE):
            score = unit[at : at + SLICE] @ centroids.T
            own[at : at + SLICE], best[at : at + SLICE] = score.argmax(1), score.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, unit)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centroids)) == 0)
        if len(empty):
            sums[empty] = unit[np.argsort(best)[: len(empty)]]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    return np.unique(centroids, axis=0)


def margin_for(unit: np.ndarray, centroids: np.ndarray, threshold: float, recall: float = RECALL, seed: int = 11) -> float:
    """The least margin that finds this share of pairs whose cosine is the threshold."""
    if len(centroids) < 2 or unit.shape[1] < 2:
        return 2.0
    rng = np.random.default_rng(seed)
    x = unit[rng.integers(len(unit), size=DRAWS)]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    y = threshold * x + np.sqrt(1 - threshold**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    gaps = np.empty(DRAWS)
    for at in range(0, DRAWS, SLICE):
        sx, sy = x[at : at + SLICE] @ centroids.T, y[at : at + SLICE] @ centroids.T
        ox, oy, row = sx.argmax(1), sy.argmax(1), np.arange(len(sx))
        gaps[at : at + SLICE] = np.minimum(sx[row, ox] - sx[row, oy], sy[row, oy] - sy[row, ox])
    return float(np.quantile(gaps, recall, method="higher")) + 1e-9


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bytes_of(kind: str):
    """Vectors as little-endian numbers; null where a vector links with nothing."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for v in b.column(1).to_pylist():
            x = None if not v or None in v else np.array(v, kind)
            out.append((x + 0.0).tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)  # one zero
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "raw"])

    return run


def _labels(hits: np.ndarray, guests: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id reachable from each vector over the block's links; only rows and columns
    with a link take part, a slice of rows at a time."""
    a, b = guests.copy(), owners.copy()
    rows, cols = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
    if not len(rows):
        return a, b
    part, top = hits[np.ix_(rows, cols)], np.iinfo(np.int64).max
    x, y = a[rows], b[cols]
    while True:
        old = (x.copy(), y.copy())
        for k in range(0, len(rows), SLICE):
            piece = part[k : k + SLICE]
            x[k : k + SLICE] = np.minimum(x[k : k + SLICE], np.where(piece, y, top).min(axis=1))
            y = np.minimum(y, np.where(piece, x[k : k + SLICE, None], top).min(axis=0))
        if (x == old[0]).all() and (y == old[1]).all():
            a[rows], b[cols] = x, y
            return a, b


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    source = keep_id(vectors, id_col, vector_col).toDF("vec_id", "embedding")
    kind = "<f4" if source.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    base = materialize(map_batches(source, _bytes_of(kind), "vec_id long, raw binary", rows=2000), "vectors")
    usable = base.where("vec_id is not null and raw is not null")
    classes = materialize(usable.groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    n = classes.count()
    sample = [r[0] for r in bounded_sample(classes.select("raw"), ["raw"], SAMPLE_ROWS, n).collect()]
    size = Counter(map(len, sample)).most_common(1)[0][0] if sample else 0
    fit = _unit([bytes(r) for r in sample if len(r) == size], kind) if sample else np.zeros((1, 1))
    centroids = spherical_kmeans(fit, max(1, min(MAX_CELLS, n // CELL_ROWS)))
    margin = margin_for(fit, centroids, threshold)

    def deal(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        raw = [bytes(r) for r in b.column("raw").to_pylist()]
        ok = np.flatnonzero([len(r) == size for r in raw])
        rest = np.flatnonzero([len(r) != size for r in raw])
        cell, own, at, seen = -np.array([len(raw[i]) for i in rest], np.int64), np.ones(len(rest), bool), rest, [b""] * len(rest)
        home = cell
        if len(ok):
            score = _unit([raw[i] for i in ok], kind) @ centroids.T
            nearest = score.argmax(1)
            visits = score >= score.max(1, keepdims=True) - margin
            who, where = np.nonzero(visits)
            packed = [v.tobytes() for v in np.packbits(visits, axis=1)]
            cell, home, own = np.concatenate([cell, where]), np.concatenate([home, nearest[who]]), np.concatenate([own, nearest[who] == where])
            at, seen = np.concatenate([at, ok[who]]), seen + [packed[i] if nearest[i] == c else b"" for i, c in zip(who, where)]
        take = pa.array(at)
        columns = [pa.array(cell, pa.int32()), pa.array(home, pa.int32()), pa.array(own), pa.array(seen, pa.binary()), b.column("rep").take(take), b.column("copies").take(take), b.column("raw").take(take)]
        return [pa.RecordBatch.from_arrays(columns, ["cell", "home", "owner", "seen", "rep", "copies", "raw"])]

    dealt = materialize(map_batches(classes, deal, "cell int, home int, owner boolean, seen binary, rep long, copies long, raw binary", rows=500), "cells")
    # a row per cell, at most MAX_CELLS and one per other dimension, so it may be broadcast
    blocks = dealt.groupBy("cell").agg(F.ceil(F.count_if("owner") / BLOCK_ROWS).alias("rows"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("cols"))
    sized = dealt.join(F.broadcast(blocks), "cell").where("rows > 0")
    draw = F.xxhash64("rep")
    facts = ["home", "seen", "rep", "copies", "raw"]
    guests = sized.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("i"), F.pmod(draw, "cols").alias("j"), F.lit(False).alias("owner"), *facts)
    owners = sized.where("owner").select("cell", F.pmod(draw, "rows").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)).alias("j"), F.lit(True).alias("owner"), *facts)

    def product(table: pa.Table) -> pa.Table:
        owner, cell = table["owner"].to_numpy(), table["cell"][0].as_py() if table.num_rows else 0
        rep, copies, home = table["rep"].to_numpy(), table["copies"].to_numpy().astype(np.float64), table["home"].to_numpy()
        raw, seen = table["raw"].to_pylist(), table["seen"].to_pylist()
        g, o = np.flatnonzero(~owner), np.flatnonzero(owner)
        if not len(g) or not len(o):
            return pa.table({c: pa.array([], pa.int64()) for c in ("id", "n", "label")})
        x, y = _unit([raw[i] for i in g], kind), _unit([raw[i] for i in o], kind).T
        # which owners visit which cells: those will meet a guest from there once more
        back = np.unpackbits(np.frombuffer(b"".join(seen[i] for i in o), np.uint8).reshape(len(o), -1), axis=1).astype(bool) if cell >= 0 else None
        hits, n_guest, n_owner = np.zeros((len(g), len(o)), bool), np.zeros(len(g)), np.zeros(len(o))
        for k in range(0, len(g), SLICE):
            part = x[k : k + SLICE] @ y >= threshold
            part[rep[g[k : k + SLICE]][:, None] == rep[o][None, :]] = False
            hits[k : k + SLICE] = part
            row, col = np.nonzero(part)
            np.add.at(n_guest, row + k, copies[o[col]])
            if back is not None and len(row):
                once = ~back[col, home[g[row + k]]]
                np.add.at(n_owner, col[once], copies[g[row[once] + k]])
        a, b = _labels(hits, rep[g], rep[o])
        ids, labels = np.concatenate([rep[g], rep[o]]), np.concatenate([a, b])
        n = np.concatenate([n_guest, n_owner]).astype(np.int64)
        some = (n > 0) | (ids != labels)
        return pa.table({"id": ids[some], "n": n[some], "label": labels[some]})

    links = materialize(guests.unionByName(owners).groupBy("cell", "i", "j").applyInArrow(released(product), "id long, n long, label long"), "links")
    comps = connected_components(links.select(F.col("id").alias("a"), F.col("label").alias("b")))
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    facts = classes.join(counts, F.col("rep") == counts["id"], "left").drop("id").join(comps, F.col("rep") == comps["id"], "left")
    facts = facts.select("raw", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "rep").alias("c"))
    out = base.withColumn("raw", F.when(F.col("vec_id").isNotNull(), F.col("raw"))).join(facts, "raw", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"))
