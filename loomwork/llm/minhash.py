"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct shingles of SHINGLE words (ASCII lower case), as 64-bit
hashes. One permutation places the shingles on a circle of CELLS cells, a second one numbers the
cells; signature coordinate k is the smallest number met when the numbers are turned k cells
against the shingles, so two permutations give all coordinates, and a shingle's contribution to all
of them is one contiguous slice.

Documents with equal sets form a class, stood for by one of them; only representatives go on, so
copies cost nothing beyond being counted. Representatives that agree in a band share a bucket, and
a bucket ties its members to the smallest of them; what is tied together is a group, and all
candidate pairs lie within groups. Comparison has two steps. First each member is compared with the
few it is tied to (spokes, a number linear in the members): sketches, the signatures' low bytes, must
agree in min_agree of the coordinates (five standard deviations below the threshold), and then full
sets are built from the texts and compared. That joins most groups, however large, into one
component, and such groups are done. In the others only pairs of different components are left: a
group is cut into blocks of at most BLOCK_MEMBERS members and BLOCK_SHINGLES shingles, and a task
compares two blocks (or many small groups), first their sketches, in matrices, which leaves members
with a partner that agrees enough; then, for those alone, texts are fetched, full sets built, and
plausible pairs compared, best first, unless already connected. A task returns a label per member,
so no list of pairs ever grows with the square of a group. Groups of over MAX_GROUP members are
compared bucket by bucket instead, by the same tasks: all candidate pairs lie in buckets as well, and
a bucket is smaller than what buckets tie together.

Defined cases: null and empty texts and texts without words have an empty set, link with nothing
and are kept; fewer words than a shingle count as one shingle; rows with a null doc_id are
reported with a null component, kept, and link with nothing; rows that share a doc_id are each
judged by their own text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import bounded_batches, discard, keep_id, map_batches, materialize, mix64, released, shuffle_partitions
from loomwork.llm.components import connected_components
from loomwork.llm.ngram_hash import word_hashes

SHINGLE = 5
BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
CELLS = 1 << 20
THRESHOLD = 85  # per cent; op5's, other callers of near_duplicates may pass their own
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1 << 20
MAX_GROUP = 50_000


def least_shingles(threshold: int) -> int:
    """With fewer shingles no different set can reach the threshold: n of n + 1 is less."""
    return -(-threshold // (100 - threshold))


def min_agree(threshold: int) -> float:
    """Five standard deviations of the agreement below the threshold, in whole hundredths."""
    p = threshold / 100
    return math.floor(100 * (p - 5 * math.sqrt(p * (1 - p) / COORDINATES))) / 100


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The placing permutation, and every window of COORDINATES consecutive cell numbers."""
    rng = np.random.default_rng(20240229)
    place = rng.permutation(CELLS).astype(np.int32)
    number = rng.permutation(CELLS).astype(np.int32)
    return place, np.lib.stride_tricks.sliding_window_view(np.concatenate([number, number[:COORDINATES]]), COORDINATES)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = word_hashes([(t or "").encode() for t in texts])
    out, at = [], 0
    factors = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
    rolled = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        rolled += hashes[j : j + len(rolled)] * factors[j]
    rolled = mix64(rolled)
    for n in counts.tolist():
        if n >= SHINGLE:
            out.append(np.unique(rolled[at : at + n - SHINGLE + 1]))
        elif n:
            whole = (hashes[at : at + n] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mix64(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    place, windows = _permutations()
    at = place[(shingles & np.uint64(CELLS - 1)).astype(np.int64)]
    low = windows[at[:2048]].min(axis=0)
    for k in range(2048, len(at), 2048):
        np.minimum(low, windows[at[k : k + 2048]].min(axis=0), out=low)
    return low


def _features(b: pa.RecordBatch, least: int) -> pa.RecordBatch:
    n, digest, bands, sketch = [], [], [], []
    salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
    factors = mix64(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)
    texts = b.column(1).to_pylist()
    for s in (s for k in range(0, len(texts), 64) for s in shingle_sets(texts[k : k + 64])):
        n.append(len(s))
        digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
        if len(s) < least:
            bands.append([])
            sketch.append(b"")
            continue
        low = signature(s)
        keys = mix64((low.reshape(BANDS, ROWS).astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64) + salt)
        bands.append(keys.view(np.int64))
        sketch.append(low.astype(np.uint8).tobytes())
    columns = [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "bands", "sketch"])


def similar(x: np.ndarray, y: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """100 * intersection >= threshold * union, for sorted distinct hashes."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= threshold * (len(x) + len(y) - common)


def _agreeing(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, agreement) of pairs whose sizes allow the threshold and whose sketches agree
    enough, 64 rows at a time."""
    out, least = [], min_agree(threshold)
    for k in range(0, len(x), 64):
        size = 100 * np.minimum(nx[k : k + 64, None], ny) >= threshold * np.maximum(nx[k : k + 64, None], ny)
        i, j = np.nonzero(size)
        share = (x[k + i] == y[j]).mean(axis=1) if len(i) <= 1 << 15 else np.concatenate([(x[k + i[c : c + (1 << 15)]] == y[j[c : c + (1 << 15)]]).mean(axis=1) for c in range(0, len(i), 1 << 15)])
        good = share >= least
        out.append((i[good] + k, j[good], share[good]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)  # type: ignore[return-value]


def _pairs_of(table: pa.Table, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Plausible pairs (row numbers and agreement) of each group in a task's table."""
    group, block, joined = table["grp"].to_numpy(), table["blk"].to_numpy(), table["c"].to_numpy()
    n = table["n"].to_numpy()
    sketch = np.frombuffer(b"".join(table["s"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
    order = np.argsort(group, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        low = rows[block[rows] == block[rows].min()]
        high = rows[block[rows] != block[rows].min()]
        within = not len(high)
        other = low if within else high
        i, j, share = _agreeing(sketch[low], sketch[other], n[low], n[other], threshold)
        apart = joined[low[i]] != joined[other[j]]
        if within:
            apart &= i < j
        i, j, share = i[apart], j[apart], share[apart]
        if len(i):
            yield low[i], other[j], share


def _screen(table: pa.Table, threshold: int) -> pa.Table:
    """Members of a task with a plausible partner."""
    found = [x for i, j, _ in _pairs_of(table, threshold) for x in (i, j)]
    return pa.table({"rep": table["rep"].take(pa.array(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)))})


def _verify(table: pa.Table, threshold: int) -> pa.Table:
    """(id, label): members of a task that are linked within it, with the smallest id they reach."""
    text = table["text"].to_pylist()
    sets = [s for k in range(0, len(text), 64) for s in shingle_sets(text[k : k + 64])]
    # rows that share a doc_id: only the one with the class's set counts
    own = np.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() == d for x, d in zip(sets, table["digest"].to_pylist())], bool)
    rep = table["rep"].to_numpy()
    parent = {int(r): int(r) for r in rep}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j, share in _pairs_of(table, threshold):
        for k in np.argsort(-share, kind="stable").tolist():
            x, y = int(i[k]), int(j[k])
            if own[x] and own[y] and (a := find(int(rep[x]))) != (b := find(int(rep[y]))) and similar(sets[x], sets[y], threshold):
                parent[max(a, b)] = min(a, b)
    linked = [(x, find(x)) for x in parent]
    linked = [(x, r) for x, r in linked if x != r]
    return pa.table({"a": pa.array([x for x, _ in linked], pa.int64()), "b": pa.array([r for _, r in linked], pa.int64())})


def _tasks(members: DataFrame, *extra: str) -> DataFrame:
    """Deal (grp, rep, c, n, s, ...) to tasks t1, t2, t3: a large group's pairs of blocks, or a pack of
    small groups. A member goes to as many tasks as its group has blocks."""
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")).where("m > 1")
    sizes = sizes.select("grp", F.ceil(F.greatest(F.col("m") / float(BLOCK_MEMBERS), F.col("w") / float(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).otherwise(0)
    rows = members.join(sizes, "grp").withColumn("blk", own)
    packs = F.pmod(F.xxhash64("grp"), F.lit(max(64, 16 * shuffle_partitions(members.sparkSession))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = F.col("blocks") > 1
    place = [F.when(large, F.col("grp")).otherwise(packs).alias("t1"), F.when(large, F.least("blk", "other")).otherwise(-1).alias("t2"), F.when(large, F.greatest("blk", "other")).otherwise(-1).alias("t3")]
    return rows.select(*place, "grp", "blk", "rep", "c", "n", "s", *extra)


def _alike(b: pa.RecordBatch, threshold: int) -> pa.RecordBatch | None:
    """The spokes whose sketches agree enough and whose sizes allow the threshold."""
    x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("s", "s2"))
    n, m = b.column("n").to_numpy(), b.column("n2").to_numpy()
    good = (100 * np.minimum(n, m) >= threshold * np.maximum(n, m)) & ((x == y).mean(axis=1) >= min_agree(threshold))
    return b.filter(pa.array(good)).select(["rep", "tie", "digest", "digest2"])


def _confirmed(b: pa.RecordBatch, threshold: int) -> pa.RecordBatch:
    """The spokes that are links by their full sets. Rows that share a doc_id: only the texts of the
    classes' sets count. A set is built once per batch."""
    texts, digests = b.column("text").to_pylist() + b.column("text2").to_pylist(), b.column("digest").to_pylist() + b.column("digest2").to_pylist()
    distinct = list(dict.fromkeys(texts))
    sets = dict(zip(distinct, (x for k in range(0, len(distinct), 64) for x in shingle_sets(distinct[k : k + 64]))))
    own = {t: hashlib.blake2b(x.tobytes(), digest_size=16).digest() for t, x in sets.items()}
    half = b.num_rows
    good = [own[texts[i]] == digests[i] and own[texts[half + i]] == digests[half + i] and similar(sets[texts[i]], sets[texts[half + i]], threshold) for i in range(half)]
    return pa.RecordBatch.from_arrays([b.column("rep"), b.column("tie")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _spoke_links(buckets: DataFrame, facts: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(a, b): links between members and the smallest members of their buckets."""
    spokes = buckets.where("rep <> tie").select("rep", "tie").distinct()
    there = facts.toDF("tie", "n2", "s2", "digest2")
    likely = map_batches(spokes.join(facts, "rep").join(there, "tie").select("rep", "tie", "n", "n2", "s", "s2", "digest", "digest2"), lambda b: _alike(b, threshold), "rep long, tie long, digest binary, digest2 binary", rows=4000)
    likely = materialize(likely, "spokes")
    wanted = likely.select(F.col("rep").alias("doc_id")).union(likely.select("tie")).distinct()
    needed = materialize(texts.join(wanted, "doc_id", "left_semi"), "spoke_texts")
    both = likely.join(needed.toDF("rep", "text"), "rep").join(needed.toDF("tie", "text2"), "tie")
    links = materialize(map_batches(both.select("rep", "tie", "digest", "digest2", "text", "text2"), lambda b: _confirmed(b, threshold), "a long, b long", rows=200), "spoke_links")
    discard(likely, needed)
    return links


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; threshold in per cent, under 100."""
    spark = docs.sparkSession
    least = least_shingles(threshold)
    bounded_batches(spark)
    feats = materialize(map_batches(keep_id(docs, "doc_id", "text"), lambda b: _features(b, least), "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary"), "minhash")
    known = feats.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = known.where(F.col("n_shingles") >= least).join(classes, "digest").where("doc_id = rep").dropDuplicates(["digest"])
    reps = materialize(reps.select("rep", F.col("n_shingles").alias("n"), "bands", F.col("sketch").alias("s"), "digest"), "reps")
    members = reps.select("rep", F.explode("bands").alias("key"))
    tied = members.groupBy("key").agg(F.min("rep").alias("tie"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "tie")
    buckets = materialize(members.join(tied, "key").select("key", "rep", "tie"), "buckets")
    groups = connected_components(buckets.select(F.col("rep").alias("a"), F.col("tie").alias("b")).where("a <> b"))
    huge = groups.groupBy("root").count().where(F.col("count") > MAX_GROUP).select("root")
    usual = groups.join(huge, "root", "left_anti").select(F.col("root").alias("grp"), F.col("id").alias("rep"))
    by_bucket = buckets.join(groups.join(huge, "root", "left_semi"), F.col("rep") == F.col("id"), "left_semi").select(F.col("key").alias("grp"), "rep")
    grouped = usual.unionByName(by_bucket)
    facts, texts = reps.select("rep", "n", "s", "digest"), keep_id(docs, "doc_id", "text")
    first = _spoke_links(buckets, facts, texts, threshold)
    joined = connected_components(first)
    # groups whose members are not all connected yet
    members = materialize(grouped.join(joined, F.col("rep") == F.col("id"), "left").select("grp", "rep", F.coalesce("root", "rep").alias("c")), "groups")
    apart = members.groupBy("grp").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("grp")
    open_ = materialize(members.join(apart, "grp", "left_semi"), "open")
    likely = _tasks(open_.join(facts, "rep")).groupBy("t1", "t2", "t3").applyInArrow(released(lambda t: _screen(t, threshold)), "rep long").distinct()
    likely = materialize(likely, "likely")
    chosen = open_.join(likely, "rep", "left_semi").join(facts, "rep")
    found = texts.join(likely, F.col("doc_id") == F.col("rep")).select("rep", "text")
    ready = _tasks(chosen, "digest").join(found, "rep")
    second = materialize(ready.groupBy("t1", "t2", "t3").applyInArrow(released(lambda t: _verify(t, threshold)), "a long, b long"), "links")
    discard(buckets, members, open_, likely)
    links = first.unionByName(second)
    comps = connected_components(links)
    roots = classes.join(comps, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("root", "rep").alias("component_id"))
    slim = feats.select("doc_id", "n_shingles", "digest")
    out = slim.join(roots, "digest", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))
