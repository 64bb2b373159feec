"""Scoring of predeclared runs with unknowns kept as unknowns, and validity of reused evidence."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from loomwork.functions.canonical import canonical_json, row_digest

#: Levels of the nested mean, outermost first, and statuses that decide or withhold an outcome.
LEVELS = ["family", "template_id", "base_id", "condition_id", "generation_id"]
FAILED = ("MODEL_FAILURE", "TIMEOUT", "OOM")
UNKNOWN = ("UNKNOWN", "INFRA_FAILURE", "MISSING_EVIDENCE")


def within(value: Column, status: Column, limit: Column) -> Column:
    """Is a measurement within its budget? A censored one only tells when it is beyond it."""
    return F.when(limit.isNull(), F.lit(True)).when(status == "CENSORED", F.when(value > limit, F.lit(False))).when(status == "MEASURED", value <= limit)


def score_repeats(expected: DataFrame, observed: DataFrame, references: DataFrame | None = None, epsilon: str = "0.20") -> DataFrame:
    """One row per expected record (record_id, model, protocol, case_id, budgets wall_budget and
    memory_budget, levels): S semantic success, B within budgets, V both, each true, false or null;
    rho against the case's frozen reference time, and near: within 1 + epsilon of it (in decimals).
    Records without an observation count as MISSING_EVIDENCE."""
    o = observed.select("record_id", "status", "semantic_pass", "wall_s", "wall_status", "memory", "memory_status")
    rows = expected.join(o, "record_id", "left").withColumn("status", F.coalesce("status", F.lit("MISSING_EVIDENCE")))
    wall = F.when(F.col("status") == "TIMEOUT", F.lit(False)).otherwise(within(F.col("wall_s"), F.col("wall_status"), F.col("wall_budget")))
    memory = F.when(F.col("status") == "OOM", F.lit(False)).otherwise(within(F.col("memory"), F.col("memory_status"), F.col("memory_budget")))
    unknown = F.col("status").isin(*UNKNOWN)
    rows = rows.withColumn("B", wall & memory).withColumn("S", F.when(F.col("status").isin(*FAILED), F.lit(False)).when(~unknown, F.col("semantic_pass")))
    rows = rows.withColumn("V", F.when(~unknown, F.col("S") & F.col("B")))
    if references is None:
        return rows.withColumn("covered", F.lit(False)).withColumn("rho", F.lit(None).cast("double")).withColumn("efficient", F.lit(None).cast("boolean"))
    rows = rows.join(references.select("case_id", "time_s"), "case_id", "left").withColumn("covered", F.col("time_s").isNotNull())
    done = (F.col("status") == "COMPLETED") & (F.col("wall_status") == "MEASURED")
    exact = lambda c: c.cast("decimal(20,6)")
    near = F.when(done, exact(F.col("wall_s")) <= (F.lit(1).cast("decimal(20,6)") + F.lit(epsilon).cast("decimal(20,6)")) * exact(F.col("time_s")))
    return rows.withColumn("rho", F.when(done, F.col("wall_s") / F.col("time_s"))).withColumn("efficient", F.when(~unknown & F.col("covered"), F.col("V") & near))


def score_panels(scored: DataFrame, value: str = "V") -> DataFrame:
    """(model, protocol, low, high, point, expected): nested means per panel with the bounds that
    unknown outcomes leave; a point only where they coincide."""
    keys = ["model", "protocol"]
    x = F.col(value).cast("double")
    out = scored.withColumn("low", F.coalesce(x, F.lit(0.0))).withColumn("high", F.coalesce(x, F.lit(1.0)))
    for k in range(len(LEVELS), -1, -1):
        out = out.groupBy(*keys, *LEVELS[:k]).agg(F.avg("low").alias("low"), F.avg("high").alias("high"))
    n = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"))
    return out.join(n, keys).withColumn("point", F.when(F.col("low") == F.col("high"), F.col("low")))


def common_cases(expected: DataFrame, panel: list[str], case: str = "case_id") -> DataFrame:
    """Cases that every panel has."""
    panels = expected.select(F.countDistinct(*panel)).scalar()
    return expected.select(*panel, case).distinct().groupBy(case).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == panels).select(case)


# --- reuse of evidence -----------------------------------------------------------------------------
def compatible_view(old: DataFrame, new: DataFrame, identity: list[str]) -> DataFrame:
    """The components of an old result that a new run confirms: for each identity the same rows."""
    def digests(df: DataFrame, name: str) -> DataFrame:
        part = F.conv(F.substring(row_digest(df), 1, 15), 16, 10).cast("decimal(38,0)")
        return df.withColumn("__h", part).groupBy(*identity).agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("__h").alias("h")).alias(name))

    same = digests(old, "x").join(digests(new.select(old.columns), "y"), identity).where("x = y").select(*identity)
    return old.join(same, identity, "left_semi").select(old.columns)


def equal_results(a: DataFrame, b: DataFrame, identity: list[str] | None = None) -> bool:
    """Do two queries give the same rows, once columns are matched by name without case and
    punctuation?"""
    key = lambda c: re.sub(r"[^a-z0-9]", "", c.lower())
    mine, theirs = {key(c): c for c in a.columns}, {key(c): c for c in b.columns}
    if mine.keys() != theirs.keys():
        return False
    x = a.select(*[F.col(f"`{mine[k]}`").alias(k) for k in sorted(mine)])
    y = b.select(*[F.col(f"`{theirs[k]}`").alias(k) for k in sorted(mine)])
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def claim_support(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """(claim, status) of claims (claim, entity, field, value) against facts (entity, field, value):
    supported, contradicted, or pending where nothing is known."""
    f = facts.groupBy("entity", "field").agg(F.collect_set("value").alias("known"))
    rows = claims.join(f, ["entity", "field"], "left")
    status = F.when(F.col("known").isNull(), "pending").when(F.array_contains("known", F.col("value")), "supported").otherwise("contradicted")
    return rows.select("claim", status.alias("status"))


def replay_fidelity(source: DataFrame, replayed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, same): did the replay give each run's observations again, as multisets?"""
    part = lambda df: F.conv(F.substring(row_digest(df), 1, 15), 16, 10).cast("decimal(38,0)")
    a = source.withColumn("__h", part(source)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("__h").alias("h"))
    b = replayed.withColumn("__h", part(replayed)).groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.sum("__h").alias("g"))
    out = a.join(b, keys, "full")
    return out.select(*keys, F.coalesce((F.col("n") == F.col("m")) & (F.col("h") == F.col("g")), F.lit(False)).alias("same"))


# --- cohorts ---------------------------------------------------------------------------------------
def refresh_matrix(rows: DataFrame, keys: list[str], answer: str, evidence: str, valid: str) -> DataFrame:
    """Counts and rates over the four cells (answer still right, evidence still enough)."""
    return rows.groupBy(*keys, answer, evidence).agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("updated"), F.avg(F.col(valid).cast("double")).alias("rate"))


def pairwise_delta(runs: DataFrame, cell: list[str], run: str, valid: str) -> DataFrame:
    """(a, b, n, valid_a, valid_b, delta) for each pair of runs over the cells both have."""
    a = runs.select(*cell, F.col(run).alias("a"), F.col(valid).cast("int").alias("va"))
    b = runs.select(*cell, F.col(run).alias("b"), F.col(valid).cast("int").alias("vb"))
    rows = a.join(b, cell).where(F.col("a") < F.col("b"))
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("va").alias("valid_a"), F.sum("vb").alias("valid_b"), F.avg(F.col("va") - F.col("vb")).alias("delta"))


def component_savings(pairs: DataFrame, keys: list[str], unit: str = "unit") -> DataFrame:
    """Per unit of work the share saved, a column per unit, null where neither did any."""
    saved = 1 - F.least("work_a", "work_b") / F.nullif(F.greatest("work_a", "work_b"), F.lit(0.0))
    return pairs.withColumn("__s", saved).groupBy(*keys).pivot(unit).agg(F.first("__s"))


def outcome_counts(attempts: DataFrame, expected: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """(status, n) with a fixed denominator: attempts that never arrived are MISSING."""
    rows = expected.select(*keys).distinct().join(attempts.select(*keys, status), keys, "left")
    return rows.groupBy(F.coalesce(status, F.lit("MISSING")).alias("status")).agg(F.count(F.lit(1)).alias("n"))



# --- values on the driver --------------------------------------------------------------------------
def normalize_shape(value, columns: list[str]):
    """Answers given as nested single lists, pairs or objects, as a list of rows."""
    while isinstance(value, list) and len(value) == 1 and isinstance(value[0], list) and value[0] and isinstance(value[0][0], list):
        value = value[0]
    if isinstance(value, dict):
        value = [value] if set(columns) <= set(value) else [[k, v] for k, v in value.items()]
    if isinstance(value, list) and len(value) == len(columns) and not any(isinstance(x, (list, dict)) for x in value):
        value = [value]
    return [[r[c] for c in columns] if isinstance(r, dict) else list(r) if isinstance(r, (list, tuple)) else [r] for r in value]


def contains(value, part) -> bool:
    """Is an object (or value) contained anywhere in a nested value?"""
    if isinstance(part, dict) and isinstance(value, dict) and all(k in value and canonical_json(value[k]) == canonical_json(v) for k, v in part.items()):
        return True
    if not isinstance(part, dict) and canonical_json(value) == canonical_json(part):
        return True
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return any(contains(x, part) for x in inner)


def symbol(text: str) -> str:
    """A dotted name without call brackets, quotes and index brackets."""
    return ".".join(p for p in re.split(r"[.:/\\]+", re.sub(r"\(.*?\)|\[.*?\]|[`'\"]", "", text.strip())) if p)


def scope_covered(required: Column, covered: Column) -> Column:
    """Are all required symbols, or a prefix of each, among the covered ones?"""
    return F.forall(required, lambda r: F.exists(covered, lambda c: (r == c) | r.startswith(F.concat(c, F.lit(".")))))


# --- the same rules on columns ---------------------------------------------------------------------
def _per_value(f, kind) -> Callable:
    """A column function of JSON texts, a batch at a time; text that is no JSON gives null."""

    def one(text):
        try:
            return None if text is None else f(json.loads(text))
        except (ValueError, TypeError, KeyError):
            return None

    return F.pandas_udf(lambda values: values.map(one), kind)


def contains_json(claim) -> Callable:
    """Is the claim contained anywhere in a JSON text?"""
    return _per_value(lambda v: contains(v, claim), BooleanType())


def shape_json(columns: list[str]) -> Callable:
    """The rows of an answer in JSON, whatever shape it was given in."""
    return _per_value(lambda v: canonical_json(normalize_shape(v, columns)), StringType())


def symbol_column(text: Column) -> Column:
    """symbol() as a column."""
    plain = F.regexp_replace(F.trim(text), r"\(.*?\)|\[.*?\]|[`'\"]", "")
    return F.array_join(F.filter(F.split(plain, r"[.:/\\]+"), lambda p: p != ""), ".")


# --- campaigns and releases ------------------------------------------------------------------------
def campaign_rates(expected: DataFrame, observed: DataFrame, keys: list[str], arm: str, success: str) -> DataFrame:
    """(arm, expected, received, rate) over attempts declared beforehand; a missing one is none that
    succeeded."""
    rows = expected.join(observed.withColumn("__r", F.lit(True)), keys, "left")
    n = F.count(F.lit(1))
    return rows.groupBy(arm).agg(n.alias("expected"), F.count("__r").alias("received"), (F.count_if(F.coalesce(F.col(success), F.lit(False))) / n).alias("rate"))


def applicable(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, applicable): does running it again give each component's evidence once more?"""
    return replay_fidelity(old, new.select(old.columns), keys).withColumnRenamed("same", "applicable")


def release_checks(df: DataFrame, rows: int, unique: list[str], balanced: list[str]) -> DataFrame:
    """(name, passed) of a released table: as many rows as announced, keys that do not repeat, and
    equally many rows for each value of the design columns."""
    count = df.agg((F.count(F.lit(1)) == rows).alias("passed")).select(F.lit("rows").alias("name"), "passed")
    keys = df.groupBy(*unique).count().agg((F.coalesce(F.max("count"), F.lit(1)) == 1).alias("passed")).select(F.lit("unique").alias("name"), "passed")
    cells = df.groupBy(*balanced).count().agg(F.coalesce(F.min("count") == F.max("count"), F.lit(True)).alias("passed")).select(F.lit("balanced").alias("name"), "passed")
    return count.unionByName(keys).unionByName(cells)
