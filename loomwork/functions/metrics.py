"""The registry of 48 run metrics, as DataFrames: one row (metric, numerator, denominator, value,
status) each. A metric without a denominator is NOT_APPLICABLE, one whose inputs were not recorded
NOT_OBSERVED; neither is a silent zero.

An episode is given as tables, all optional:
  fields    (field, ok, changed, stale, support, unsupported, answered)  requested answer fields
  atoms     (atom, hit, worker_hit, before_hit)                          atomic parts of the answer
  claims    (claim, factual, supported)                                  explicit claims
  expected, returned, gaps  (id)                                         collections of ids
  bindings  (binding, correct)                                           values bound to entities
  findings  (finding, is_true, is_clean), clean (finding)                reported faults
  required_checks, run_checks (check)                                    checks to run, and run
  refs      (artifact_id, known)                                         cited evidence
  events    the event table; attempts (role, status, cost, reserved)
  rows      (result, key)                                                rows of query results
  adoption  (exposed, adopted, correct), spread (inherited, checked)     a planted false claim
  roots     (ref, root, declared)                                        provenance of evidence
  confirmations (claim, independent)                                     claims of independence
  state     (key, difference)                                            native state against contract
  uncertain (write, reconciled), faults (exposed, recovered)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.traces import interval_union

NAMES = {
    "M01": "success", "M02": "atom recall", "M03": "claim precision", "M04": "collection recall", "M05": "collection precision", "M06": "duplicate share", "M07": "gap kept", "M08": "gap recovered",
    "M09": "worker coverage", "M10": "worker retention", "M11": "binding", "M12": "finding precision", "M13": "known evidence", "M14": "claim support", "M15": "field support", "M16": "evidence applicability",
    "M17": "changed fields right", "M18": "stable fields right", "M19": "stale fields", "M20": "work after update", "M21": "field completion", "M22": "update latency", "M23": "dispatch counts", "M24": "revision gains",
    "M25": "diagnosis", "M26": "analysis fields", "M27": "row multiplicity", "M28": "false claim adopted", "M29": "false claim corrected", "M30": "false claim spread", "M31": "provenance classes", "M32": "false independence",
    "M33": "unsupported answered", "M34": "supported right", "M35": "clean cases accused", "M36": "check coverage", "M37": "native state", "M38": "collateral changes", "M39": "reconciled writes", "M40": "fault recovery",
    "M41": "work", "M42": "requests", "M43": "cost", "M44": "time", "M45": "work saving", "M46": "time saving", "M47": "pass^k", "M48": "deadline met",
}
COLUMNS = "metric string, numerator bigint, denominator bigint, value double, status string"
Tables = dict[str, DataFrame]


def rate(metric: str, df: DataFrame, hit: Column, counted: Column | None = None) -> DataFrame:
    counted = counted if counted is not None else F.lit(True)
    n, d = F.count_if(hit & counted), F.count_if(counted)
    return df.agg(n.alias("numerator"), d.alias("denominator")).select(F.lit(metric).alias("metric"), "numerator", "denominator", F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator")).alias("value"), F.when(F.col("denominator") > 0, "MEASURED").otherwise("NOT_APPLICABLE").alias("status"))


def amount(metric: str, df: DataFrame, value: Column) -> DataFrame:
    """A measured quantity; null where nothing was recorded."""
    none = F.lit(None).cast("bigint")
    return df.agg(value.cast("double").alias("value")).select(F.lit(metric).alias("metric"), none.alias("numerator"), none.alias("denominator"), "value", F.when(F.col("value").isNotNull(), "MEASURED").otherwise("NOT_OBSERVED").alias("status"))


def members(metric: str, whole: DataFrame, part: DataFrame, key: str = "id", missing: bool = False) -> DataFrame:
    """The share of distinct keys of whole that are in part (or are not)."""
    marked = whole.select(key).distinct().join(part.select(key).distinct().withColumn("__in", F.lit(True)), key, "left")
    inside = F.col("__in").isNotNull()
    return rate(metric, marked, ~inside if missing else inside)


def recall(expected: DataFrame, returned: DataFrame, key: str = "id") -> DataFrame:
    return members("M04", expected, returned, key)


def precision(expected: DataFrame, returned: DataFrame, key: str = "id") -> DataFrame:
    return members("M05", returned, expected, key)


def duplicates(returned: DataFrame, key: str = "id") -> DataFrame:
    per = returned.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("numerator"), F.coalesce(F.sum("n"), F.lit(0)).alias("denominator"))
    return out.select(F.lit("M06").alias("metric"), "numerator", "denominator", F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator")).alias("value"), F.when(F.col("denominator") > 0, "MEASURED").otherwise("NOT_APPLICABLE").alias("status"))


def multiplicity(rows: DataFrame) -> DataFrame:
    """Repeated keys within a result, against its distinct ones."""
    per = rows.groupBy("result", "key").agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("numerator"), F.count(F.lit(1)).alias("denominator"))
    return out.select(F.lit("M27").alias("metric"), "numerator", "denominator", F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator")).alias("value"), F.when(F.col("denominator") > 0, "MEASURED").otherwise("NOT_APPLICABLE").alias("status"))


def _work(events: DataFrame) -> Column:
    return F.sum(F.aggregate(F.map_values("resource_delta"), F.lit(0.0), lambda s, v: s + v))


def _update_end(t: Tables) -> Column:
    end = t["events"].where("kind = 'environment_update'").agg(F.min("monotonic_end"))
    return end.scalar()


def critical_path(spans: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(seconds) of the longest chain of dependent tasks: spans (task_id, seconds), edges (task_id,
    needs). Rounds of relaxation, each stored."""
    from loomwork.sources.storage import store

    best = store(spans.select("task_id", "seconds", F.col("seconds").alias("total")), "path")
    for _ in range(max_rounds):
        up = edges.join(best.select(F.col("task_id").alias("needs"), F.col("total").alias("t")), "needs").groupBy("task_id").agg(F.max("t").alias("t"))
        new = store(best.join(up, "task_id", "left").select("task_id", "seconds", F.greatest("total", F.col("seconds") + F.coalesce("t", F.lit(0.0))).alias("total"), (F.coalesce(F.col("seconds") + F.col("t"), F.lit(0.0)) > F.col("total")).alias("moved")), "path")
        best = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return best.agg(F.max("total").alias("seconds"))


#: metric -> (tables it needs, how it is computed from them)
DEFINITIONS: dict[str, tuple[tuple[str, ...], Callable[[Tables], DataFrame]]] = {
    "M01": (("fields",), lambda t: rate("M01", t["fields"].agg(F.bool_and(F.col("ok") & F.col("support")).alias("s")), F.coalesce("s", F.lit(False)))),
    "M02": (("atoms",), lambda t: rate("M02", t["atoms"], F.col("hit"))),
    "M03": (("claims",), lambda t: rate("M03", t["claims"], F.col("factual"))),
    "M04": (("expected", "returned"), lambda t: recall(t["expected"], t["returned"])),
    "M05": (("expected", "returned"), lambda t: precision(t["expected"], t["returned"])),
    "M06": (("returned",), lambda t: duplicates(t["returned"])),
    "M07": (("gaps", "returned"), lambda t: members("M07", t["gaps"], t["returned"], missing=True)),
    "M08": (("gaps", "returned"), lambda t: members("M08", t["gaps"], t["returned"])),
    "M09": (("atoms",), lambda t: rate("M09", t["atoms"], F.col("worker_hit"))),
    "M10": (("atoms",), lambda t: rate("M10", t["atoms"], F.col("hit"), F.col("worker_hit"))),
    "M11": (("bindings",), lambda t: rate("M11", t["bindings"], F.col("correct"))),
    "M12": (("findings",), lambda t: rate("M12", t["findings"], F.col("is_true"))),
    "M13": (("refs",), lambda t: rate("M13", t["refs"], F.col("known"))),
    "M14": (("claims",), lambda t: rate("M14", t["claims"], F.col("supported"))),
    "M15": (("fields",), lambda t: rate("M15", t["fields"], F.col("support"))),
    "M16": (("fields",), lambda t: rate("M16", t["fields"], F.col("support"))),
    "M17": (("fields",), lambda t: rate("M17", t["fields"], F.col("ok"), F.col("changed"))),
    "M18": (("fields",), lambda t: rate("M18", t["fields"], F.col("ok"), ~F.col("changed"))),
    "M19": (("fields",), lambda t: rate("M19", t["fields"], F.col("stale") & ~F.col("ok"), F.col("changed"))),
    "M20": (("events",), lambda t: amount("M20", t["events"].where(F.col("monotonic_start") >= _update_end(t)), _work(t["events"]))),
    "M21": (("fields",), lambda t: rate("M21", t["fields"], F.col("ok"))),
    "M22": (("events",), lambda t: amount("M22", t["events"].where((F.col("kind") == "manager_decision_started") & (F.col("monotonic_start") >= _update_end(t))).withColumn("__u", _update_end(t)), F.min(F.col("monotonic_start") - F.col("__u")))),
    "M23": (("events",), lambda t: rate("M23", t["events"], F.col("kind") == "worker_finished", F.col("kind").isin("worker_finished", "worker_failed", "action_rejected"))),
    "M24": (("atoms",), lambda t: rate("M24", t["atoms"], F.col("hit"), ~F.col("before_hit"))),
    "M25": (("fields",), lambda t: rate("M25", t["fields"], F.col("ok"), F.col("field").isin("root_service", "fault_type"))),
    "M26": (("fields",), lambda t: rate("M26", t["fields"], F.col("ok"))),
    "M27": (("rows",), lambda t: multiplicity(t["rows"])),
    "M28": (("adoption",), lambda t: rate("M28", t["adoption"], F.col("adopted"), F.col("exposed"))),
    "M29": (("adoption",), lambda t: rate("M29", t["adoption"], F.col("correct") & ~F.col("adopted"), F.col("exposed"))),
    "M30": (("spread",), lambda t: rate("M30", t["spread"], F.col("inherited") & ~F.col("checked"))),
    "M31": (("roots",), lambda t: amount("M31", t["roots"], F.countDistinct("root"))),
    "M32": (("confirmations",), lambda t: rate("M32", t["confirmations"], ~F.col("independent"), F.col("independent").isNotNull())),
    "M33": (("fields",), lambda t: rate("M33", t["fields"], F.col("unsupported"), F.col("answered"))),
    "M34": (("fields",), lambda t: rate("M34", t["fields"], F.col("ok"), ~F.col("unsupported"))),
    "M35": (("findings", "clean"), lambda t: members("M35", t["clean"], t["findings"], "finding")),
    "M36": (("required_checks", "run_checks"), lambda t: members("M36", t["required_checks"], t["run_checks"], "check")),
    "M37": (("state",), lambda t: rate("M37", t["state"], F.col("difference").isNull())),
    "M38": (("state",), lambda t: amount("M38", t["state"], F.count_if(F.col("difference").isin("changed", "unexpected")))),
    "M39": (("uncertain",), lambda t: rate("M39", t["uncertain"], F.col("reconciled"))),
    "M40": (("faults",), lambda t: rate("M40", t["faults"], F.col("recovered"), F.col("exposed"))),
    "M41": (("events",), lambda t: amount("M41", t["events"], _work(t["events"]))),
    "M42": (("attempts",), lambda t: rate("M42", t["attempts"], F.col("status") == "SETTLED")),
    "M43": (("attempts",), lambda t: amount("M43", t["attempts"], F.sum(F.when(F.col("status") == "SETTLED", F.col("cost")).otherwise(F.col("reserved"))))),
    "M44": (("events",), lambda t: amount("M44", interval_union(t["events"].where("kind in ('model_completed', 'tool_completed')"), [], "monotonic_start", "monotonic_end"), F.max("seconds"))),
    "M45": (("pair",), lambda t: amount("M45", t["pair"], F.avg((F.col("work_a") - F.col("work_b")) / F.nullif(F.col("work_a"), F.lit(0.0))))),
    "M46": (("pair",), lambda t: amount("M46", t["pair"], F.avg((F.col("time_a") - F.col("time_b")) / F.nullif(F.col("time_a"), F.lit(0.0))))),
    "M47": (("repeats",), lambda t: amount("M47", t["repeats"], F.count_if("success") * (F.count_if("success") - 1) / F.nullif(F.count(F.lit(1)) * (F.count(F.lit(1)) - 1), F.lit(0)))),
    "M48": (("deadlines",), lambda t: rate("M48", t["deadlines"], F.col("met"))),
}


def registry(tables: Tables, metrics: list[str] | None = None) -> DataFrame:
    """All metrics of an episode; those whose tables are not given are NOT_OBSERVED."""
    spark = next(iter(tables.values())).sparkSession
    rows, absent = [], []
    for name in metrics or DEFINITIONS:
        needs, compute = DEFINITIONS[name]
        if all(n in tables for n in needs):
            rows.append(compute(tables))
        else:
            absent.append((name, None, None, None, "NOT_OBSERVED"))
    out = spark.createDataFrame(absent, COLUMNS)
    for r in rows:
        out = out.unionByName(r.select("metric", "numerator", "denominator", F.col("value").cast("double").alias("value"), "status"))
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return out.withColumn("name", names[F.col("metric")])


def grades(df: DataFrame, answer: Column, evidence: Column) -> DataFrame:
    """Adds Q1 (the answer is right), Q2 (its evidence is enough) and G (both)."""
    return df.withColumn("Q1", answer).withColumn("Q2", evidence).withColumn("G", F.col("Q1") & F.col("Q2"))
