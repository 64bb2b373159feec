"""Trace analytics: intervals, work, comparisons between runs, adaptation, ledgers, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- intervals -----------------------------------------------------------------------------------
TIME_BUCKETS = 64


def _beside(df: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """Facts joined to each row; null keys meet null keys."""
    other = facts.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(on)})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(on)])
    return df.join(other, same, "left").drop(*[f"__k{i}" for i in range(len(on))])


def _in_time_buckets(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Adds __b: which part of its key's time a row lies in, so that the rows of one key, however
    many, are ordered part by part; what crosses the border is carried over in a row per part."""
    lo, hi = F.min(time).alias("__lo"), F.max(time).alias("__hi")
    if keys:
        wide = _beside(df, df.groupBy(*keys).agg(lo, hi), keys)
    else:
        wide = df.withColumn("__lo", df.agg(lo).scalar()).withColumn("__hi", df.agg(hi).scalar())
    part = F.floor((F.col(time) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * TIME_BUCKETS)
    bucket = F.when(F.col("__hi") > F.col("__lo"), F.least(part, F.lit(TIME_BUCKETS - 1))).otherwise(F.lit(0))
    return wide.withColumn("__b", F.coalesce(bucket, F.lit(0)).cast("int")).drop("__lo", "__hi")


def interval_union(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, seconds): length of the union of each key's intervals. What an interval adds is what
    lies beyond the furthest end so far."""
    parts = _in_time_buckets(spans, keys, start)
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    tops = parts.groupBy(*keys, "__b").agg(F.max(end).alias("__top")).withColumn("__carry", F.max("__top").over(earlier)).drop("__top")
    w = Window.partitionBy(*keys, "__b").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    before = F.greatest(F.max(end).over(w), F.col("__carry"))
    added = F.greatest(F.lit(0.0), F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start))))
    return _beside(parts, tops, [*keys, "__b"]).withColumn("__add", added).groupBy(*keys).agg(F.sum("__add").alias("seconds"))


def overlap(spans: DataFrame, keys: list[str], kind: str = "kind", a: str = "model", b: str = "tool") -> DataFrame:
    """(keys, a, b, active, overlap): seconds of either kind, of their union, and shared ones."""
    sides = [interval_union(spans.where(F.col(kind) == x), keys).withColumnRenamed("seconds", n) for x, n in ((a, "a"), (b, "b"))]
    both = interval_union(spans.where(F.col(kind).isin(a, b)), keys).withColumnRenamed("seconds", "active")
    out = both.join(sides[0], keys, "left").join(sides[1], keys, "left").fillna(0.0, ["a", "b"])
    return out.withColumn("overlap", F.col("a") + F.col("b") - F.col("active"))


def pair_spans(events: DataFrame, key: str = "task_id", time: str = "t", kind: str = "kind") -> DataFrame:
    """(key, start, end, outcome): each start with the next finish or failure of its key; a start
    without one has a null end."""
    w = Window.partitionBy(key).orderBy(time)
    after = events.withColumn("end", F.lead(time).over(w)).withColumn("outcome", F.lead(kind).over(w)).where(F.col(kind) == "worker_started")
    closed = F.col("outcome").isin("worker_finished", "worker_failed")
    return after.select(key, F.col(time).alias("start"), F.when(closed, F.col("end")).alias("end"), F.when(closed, F.col("outcome")).alias("outcome"))


def live_buffers(buffers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, peak, byte_time, unreleased) of buffers (bytes, created, released or null); at equal
    times releases come first."""
    born = buffers.select(*keys, F.col("created").alias("t"), F.lit(1).alias("o"), F.col("bytes").alias("d"))
    gone = buffers.where("released is not null").select(*keys, F.col("released").alias("t"), F.lit(0).alias("o"), (-F.col("bytes")).alias("d"))
    parts = _in_time_buckets(born.unionByName(gone), keys, "t")
    order = Window.partitionBy(*keys).orderBy("__b")
    sums = parts.groupBy(*keys, "__b").agg(F.sum("d").alias("__d"), F.min("t").alias("__t"))
    sums = sums.select(*keys, "__b", F.sum("__d").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"), F.lead("__t").over(order).alias("__next"))
    w = Window.partitionBy(*keys, "__b").orderBy("t", "o", "d")
    live = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("__carry", F.lit(0))
    moves = _beside(parts, sums, [*keys, "__b"]).withColumn("live", live).withColumn("dt", F.coalesce(F.lead("t").over(w), F.col("__next")) - F.col("t"))
    return moves.groupBy(*keys).agg(F.greatest(F.max("live"), F.lit(0)).alias("peak"), F.sum(F.col("live") * F.coalesce("dt", F.lit(0))).alias("byte_time"), F.sum("d").alias("unreleased"))


def byte_totals(events: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per column the total (null if any is missing), the sum of those present, and the missing."""
    out = []
    for c in columns:
        missing = F.count_if(F.col(c).isNull())
        out += [F.when(missing == 0, F.sum(c)).alias(c), F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_known"), missing.alias(f"{c}_missing")]
    return events.groupBy(*keys).agg(*out)


# --- work ----------------------------------------------------------------------------------------
def work_vector(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unit, work): resource deltas summed over events that are not inherited; a retried
    attempt counts again."""
    rows = events.where(~F.col("inherited")).select(*keys, F.explode("resource_delta").alias("unit", "amount"))
    return rows.groupBy(*keys, "unit").agg(F.sum("amount").alias("work"))


def run_pairs(runs: DataFrame, cell: list[str], run: str = "model") -> DataFrame:
    """Pairs of runs of one cell, a before b, with all columns suffixed: a self join on the cell's
    keys, whose cells hold one run per model."""
    a = runs.select(*[F.col(c).alias(c if c in cell else f"{c}_a") for c in runs.columns])
    b = runs.select(*[F.col(c).alias(c if c in cell else f"{c}_b") for c in runs.columns])
    return a.join(b, cell).where(F.col(f"{run}_a") < F.col(f"{run}_b"))


def relation(pairs: DataFrame, keys: list[str], a: str = "work_a", b: str = "work_b") -> DataFrame:
    """(keys, relation) from rows per unit: equal, a_dominates (no more work in any unit, less in
    one), b_dominates, or tradeoff."""
    le, ge = F.bool_and(F.col(a) <= F.col(b)), F.bool_and(F.col(a) >= F.col(b))
    out = F.when(le & ge, "equal").when(le, "a_dominates").when(ge, "b_dominates").otherwise("tradeoff")
    return pairs.groupBy(*keys).agg(out.alias("relation"))


def savings(pairs: DataFrame) -> DataFrame:
    """From (work_a, work_b, time_a, time_b) of dominated pairs: savings S = 1 - less / more in
    work and time, gap D = S_W - S_T, and the outcome class."""
    lower_is_a = F.col("work_a") <= F.col("work_b")
    sw = 1 - F.least("work_a", "work_b") / F.greatest("work_a", "work_b")
    t_lo, t_hi = F.when(lower_is_a, F.col("time_a")).otherwise(F.col("time_b")), F.when(lower_is_a, F.col("time_b")).otherwise(F.col("time_a"))
    out = pairs.where("greatest(work_a, work_b) > 0 and time_a > 0 and time_b > 0").withColumn("work_saving", sw).withColumn("time_saving", 1 - t_lo / t_hi)
    d = F.col("work_saving") - F.col("time_saving")
    kind = F.when(F.col("time_saving") <= 0, "none").when(F.col("time_saving") < F.col("work_saving"), "attenuated").otherwise("proportional")
    return out.withColumn("gap", d).withColumn("outcome", kind)


def parent_mean(df: DataFrame, groups: list[str], parent: str, value: str) -> DataFrame:
    """(groups, mean, parents): pairs averaged within a parent, then parents equally."""
    inner = df.groupBy(*groups, parent).agg(F.avg(value).alias("__m"))
    return inner.groupBy(*groups).agg(F.avg("__m").alias("mean"), F.count(F.lit(1)).alias("parents"))


def _drawn(seed: int, *parts: Column | str) -> Column:
    """A whole number from 0 to 2^32 - 1 that follows from the seed and the parts alone."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def bootstrap(df: DataFrame, groups: list[str], parent: str, value: str, draws: int = 4000, seed: int = 1, cluster: str | None = None) -> DataFrame:
    """(groups, mean, low, high): percentile interval over resampled parents, or over clusters and
    then parents. Parents are averaged first; each draw is a set of rows that say which parent to
    take, from digests of the draw and the place, so all draws run at once and any executor that is
    lost draws the same again. NULL is no group."""
    means = df.groupBy(*groups, *([cluster] if cluster else []), parent).agg(F.avg(value).alias("__m"))
    if cluster:
        names = means.groupBy(*groups, cluster).agg(F.count(F.lit(1)).alias("__n"))
        names = names.withColumn("__c", F.row_number().over(Window.partitionBy(*groups).orderBy(cluster)) - 1)
        own = means.join(names.drop("__n"), [*groups, cluster])
        place = Window.partitionBy(*groups, "__c").orderBy(parent)
        clusters = names.groupBy(*groups).agg(F.count(F.lit(1)).alias("__k"))
        picks = clusters.select(*groups, "__k", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("__b"))
        picks = picks.select(*groups, "__k", "__b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1)).alias("__j"))
        picks = picks.select(*groups, "__b", "__j", (_drawn(seed, "c", F.col("__b"), F.col("__j")) % F.col("__k")).alias("__c")).join(names.drop(cluster), [*groups, "__c"])
        key = ["__c", "__i"]
        slot = [F.col("__b"), F.col("__j"), F.col("__s")]
    else:
        own, place = means, Window.partitionBy(*groups).orderBy(parent)
        picks = means.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n")).select(*groups, "__n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("__b"))
        key, slot = ["__i"], [F.col("__b"), F.col("__s")]
    picks = picks.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).withColumn("__i", _drawn(seed, *slot) % F.col("__n"))
    own = own.withColumn("__i", F.row_number().over(place) - 1)
    stats = picks.join(own.select(*groups, *key, "__m"), [*groups, *key]).groupBy(*groups, "__b").agg(F.avg("__m").alias("__x"))
    limits = stats.groupBy(*groups).agg(F.percentile("__x", 0.025).alias("low"), F.percentile("__x", 0.975).alias("high"))
    return means.groupBy(*groups).agg(F.avg("__m").alias("mean")).join(limits, groups)


def leave_one_out(df: DataFrame, groups: list[str], cluster: str, value: str) -> DataFrame:
    """(groups, left_out, mean): the mean without each cluster, from sums and counts."""
    per = df.groupBy(*groups, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    w = Window.partitionBy(*groups)
    all_s, all_n = F.sum("s").over(w), F.sum("n").over(w)
    return per.select(*groups, F.col(cluster).alias("left_out"), F.when(all_n > F.col("n"), (all_s - F.col("s")) / (all_n - F.col("n"))).alias("mean"))


# --- adaptation ----------------------------------------------------------------------------------
def fold_stages(attempts: DataFrame, keys: list[str], sums: list[str], last: list[str], order: str = "attempt") -> DataFrame:
    """One row per logical stage: amounts add up over attempts, quality is the last one's."""
    return attempts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max_by(c, order).alias(c) for c in last], F.count(F.lit(1)).alias("attempts"))


def adaptation(stages: DataFrame, cell: list[str], condition: str = "condition", valid: str = "valid") -> DataFrame:
    """(condition, n, adapted, rate): valid updates among cells whose base is valid."""
    base = stages.where((F.col(condition) == "base") & F.col(valid)).select(*cell)
    updates = stages.where(F.col(condition) != "base").join(base, cell, "left_semi")
    return updates.groupBy(condition).agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("adapted"), F.avg(F.col(valid).cast("double")).alias("rate"))


def availability(df: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """(keys, low, high): the confirmed share, and that with the unresolved."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg((F.count_if(F.col(status) == "confirmed") / n).alias("low"), (F.count_if(F.col(status).isin("confirmed", "unresolved")) / n).alias("high"))


def common_support(df: DataFrame, cell: list[str], run: str, valid: str = "valid") -> DataFrame:
    """Cells that are valid for every run."""
    n = df.select(F.countDistinct(run)).scalar()
    return df.where(valid).groupBy(*cell).agg(F.countDistinct(run).alias("__n")).where(F.col("__n") == n).select(*cell)


def hierarchical_bounds(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """(low, high): nested means, outermost level last; an unknown value lies anywhere in [0, 1]."""
    x = F.col(value).cast("double")
    out = df.withColumn("low", F.coalesce(x, F.lit(0.0))).withColumn("high", F.coalesce(x, F.lit(1.0)))
    for k in range(len(levels), -1, -1):
        out = out.groupBy(*levels[:k]).agg(F.avg("low").alias("low"), F.avg("high").alias("high"))
    return out


def all_known(columns: list[Column]) -> Column:
    """Three-valued conjunction: false if any is false, else unknown if any is."""
    return reduce(Column.__and__, columns)


def budget_met(time: Column, limit: Column, censored: Column, passed: Column) -> Column:
    """Passed within the budget; a run stopped before the limit is unknown."""
    return F.when(passed & (time <= limit), True).when(censored & (time < limit), None).otherwise(False)


# --- ledgers -------------------------------------------------------------------------------------
def chain_faults(ledger: DataFrame, key: str = "run_id", seq: str = "sequence") -> DataFrame:
    """Entries that break a hash chain: sequence not contiguous from 0, clock going back, or the
    previous digest not that of the entry before."""
    w = Window.partitionBy(key).orderBy(seq)
    checked = ledger.select(key, seq, F.lag(seq).over(w).alias("s"), F.lag("monotonic_ns").over(w).alias("t"), F.lag("sha256").over(w).alias("h"), "monotonic_ns", "previous_sha256")
    bad = (F.col(seq) != F.coalesce(F.col("s") + 1, F.lit(0))) | (F.col("monotonic_ns") < F.coalesce("t", "monotonic_ns")) | ~F.col("previous_sha256").eqNullSafe(F.col("h"))
    return checked.where(bad).select(key, seq)


def manifest_gaps(expected: DataFrame, received: DataFrame, keys: list[str]) -> DataFrame:
    """(expected, received, missing): the denominator is fixed, what is missing stays counted."""
    marked = expected.select(*keys).distinct().join(received.select(*keys).distinct().withColumn("__r", F.lit(1)), keys, "left")
    return marked.agg(F.count(F.lit(1)).alias("expected"), F.count("__r").alias("received"), F.count_if(F.col("__r").isNull()).alias("missing"))


def node_state_faults(events: DataFrame, key: str = "node_id", seq: str = "sequence", state: str = "state") -> DataFrame:
    """Events that do not follow queued, ready, started, finished or failed."""
    w = Window.partitionBy(key).orderBy(seq)
    legal = {"queued": [None], "ready": ["queued"], "started": ["ready"], "finished": ["started"], "failed": ["ready", "started"]}
    before = F.coalesce(F.lag(state).over(w), F.lit(""))
    ok = reduce(Column.__or__, [(F.col(state) == s) & before.isin([b or "" for b in p]) for s, p in legal.items()])
    return events.withColumn("__ok", ok).where(~F.col("__ok")).drop("__ok")


# --- cohorts and timing domains --------------------------------------------------------------------
def primary_work(stages: DataFrame, unit: dict[str, str], scene: str = "scene", work: str = "work") -> DataFrame:
    """Adds primary: the amount of the scene's own unit in the work map; null without one."""
    units = F.create_map(*[F.lit(x) for pair in unit.items() for x in pair])
    return stages.withColumn("primary", F.col(work)[units[F.col(scene)]])


def savings_by_timing(pairs: DataFrame, domains: dict[str, tuple[Column, Column]]) -> DataFrame:
    """savings() of the same pairs in every timing domain, which are columns of time for a and b."""
    times = F.explode(F.array(*[F.struct(F.lit(k).alias("timing"), a.cast("double").alias("time_a"), b.cast("double").alias("time_b")) for k, (a, b) in domains.items()])).alias("__t")
    return savings(pairs.select(*[c for c in pairs.columns if c not in ("time_a", "time_b")], times).select("*", "__t.*").drop("__t"))


def matched_timing(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """The runs that have a time in every domain, with all of them side by side."""
    out = tables[0]
    for table in tables[1:]:
        out = out.join(table, keys)
    return out


def concat_cohorts(cohorts: list[DataFrame]) -> DataFrame:
    """Cohorts one after the other; a number that a cohort does not have is zero."""
    out = cohorts[0]
    for c in cohorts[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out.fillna(0)


def update_exposure(events: DataFrame, order: str, trigger: str) -> DataFrame:
    """(order, version, exposed): the first trigger moves the source to version 2, for all that
    comes later."""
    first = events.where(trigger).agg(F.min(order)).scalar()
    later = F.coalesce(F.col(order) > first, F.lit(False))
    return events.select(order, F.when(later, 2).otherwise(1).alias("version"), later.alias("exposed"))


def continued(prefix: DataFrame, new: DataFrame, elapsed: float, time: str, cost: str) -> DataFrame:
    """A branch's events: those inherited from the prefix lie before time zero and cost nothing."""
    old = prefix.withColumn(time, F.col(time) - elapsed).withColumn(cost, F.lit(0.0)).withColumn("inherited", F.lit(True))
    return old.unionByName(new.withColumn("inherited", F.lit(False)))
