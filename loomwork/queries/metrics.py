"""All 48 metrics of one episode whose tables are derived from the driver's by fixed rules, and their
SQL, a line for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import metrics as M
from loomwork.queries.base import query, t

#: The episode's tables in SQL; Spark runs the same expressions.
_TABLES = {
    "fields": ("orders", "CASE o_orderkey % 10 WHEN 0 THEN 'root_service' WHEN 1 THEN 'fault_type' ELSE 'other' END AS field, o_orderstatus = 'F' AS ok, o_orderkey % 2 = 0 AS changed, o_orderkey % 3 = 0 AS stale, o_orderkey % 5 <> 0 AS support, o_orderkey % 7 = 0 AS unsupported, o_orderkey % 11 <> 0 AS answered"),
    "atoms": ("customer", "c_custkey AS atom, c_custkey % 2 = 0 AS hit, c_custkey % 3 <> 0 AS worker_hit, c_custkey % 4 = 0 AS before_hit"),
    "claims": ("part", "p_partkey AS claim, p_partkey % 4 <> 0 AS factual, p_partkey % 6 <> 0 AS supported"),
    "expected": ("orders", "o_orderkey AS id"),
    "returned": ("lineitem", "l_orderkey + 1 AS id"),
    "gaps": ("orders", "o_orderkey * 10 AS id"),
    "bindings": ("supplier", "s_suppkey AS binding, s_suppkey % 3 <> 0 AS correct"),
    "findings": ("part", "p_partkey * 2 AS finding, p_partkey % 4 = 0 AS is_true, p_partkey % 5 = 0 AS is_clean"),
    "clean": ("part", "p_partkey AS finding"),
    "required_checks": ("nation", 'n_nationkey AS "check"'),
    "run_checks": ("nation", 'n_nationkey + 3 AS "check"'),
    "refs": ("customer", "c_custkey AS artifact_id, c_custkey % 9 <> 0 AS known"),
    "attempts": ("orders", "CASE WHEN o_orderstatus = 'F' THEN 'SETTLED' ELSE 'OPEN' END AS status, CAST(o_orderkey % 100 AS DOUBLE) AS cost, CAST(o_orderkey % 50 AS DOUBLE) AS reserved"),
    "rows": ("lineitem", "l_returnflag AS result, l_partkey AS key"),
    "adoption": ("customer", "c_custkey % 2 = 0 AS exposed, c_custkey % 3 = 0 AS adopted, c_custkey % 5 <> 0 AS correct"),
    "spread": ("supplier", "s_suppkey % 2 = 0 AS inherited, s_suppkey % 3 = 0 AS checked"),
    "roots": ("orders", "o_orderkey AS ref, o_custkey AS root, true AS declared"),
    "confirmations": ("part", "p_partkey AS claim, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 2 = 0 END AS independent"),
    "state": ("orders", "o_orderkey AS key, CASE o_orderkey % 10 WHEN 1 THEN 'changed' WHEN 2 THEN 'missing' WHEN 3 THEN 'unexpected' END AS difference"),
    "uncertain": ("supplier", "s_suppkey AS write, s_suppkey % 4 <> 0 AS reconciled"),
    "faults": ("supplier", "s_suppkey % 2 = 0 AS exposed, s_suppkey % 6 = 0 AS recovered"),
    "pair": ("customer", "CAST(c_custkey % 7 AS DOUBLE) AS work_a, CAST(c_custkey % 3 AS DOUBLE) AS work_b, CAST(c_custkey % 5 AS DOUBLE) AS time_a, CAST(c_custkey % 4 AS DOUBLE) AS time_b"),
    "repeats": ("nation", "n_nationkey % 2 = 0 AS success"),
    "deadlines": ("orders", "o_totalprice <= 100000 AS met"),
    "events": ("events", "CASE event_id % 6 WHEN 0 THEN 'environment_update' WHEN 1 THEN 'manager_decision_started' WHEN 2 THEN 'worker_finished' WHEN 3 THEN 'worker_failed' WHEN 4 THEN 'model_completed' ELSE 'tool_completed' END AS kind, CAST(event_id AS DOUBLE) AS monotonic_start, CAST(event_id + 2 + event_id % 5 AS DOUBLE) AS monotonic_end, CAST(event_id % 4 AS DOUBLE) AS calls"),
}


def _rate(table: str, hit: str, counted: str = "true") -> str:
    return f"SELECT count(*) FILTER (({hit}) AND ({counted})) AS n, count(*) FILTER ({counted}) AS d FROM {table}"


def _share(whole: str, part: str, key: str = "id", word: str = "IN") -> str:
    return f'SELECT count(*) FILTER ("{key}" {word} (SELECT "{key}" FROM {part})) AS n, count(*) AS d FROM (SELECT DISTINCT "{key}" FROM {whole})'


#: metric -> numerator and denominator.
_RATES = {
    "M01": "SELECT CAST(bool_and(ok AND support) AS INTEGER) AS n, 1 AS d FROM fields", "M02": _rate("atoms", "hit"), "M03": _rate("claims", "factual"), "M04": _share("expected", "returned"), "M05": _share("returned", "expected"),
    "M06": "SELECT count(*) - count(DISTINCT id) AS n, count(*) AS d FROM returned", "M07": _share("gaps", "returned", word="NOT IN"), "M08": _share("gaps", "returned"), "M09": _rate("atoms", "worker_hit"), "M10": _rate("atoms", "hit", "worker_hit"),
    "M11": _rate("bindings", "correct"), "M12": _rate("findings", "is_true"), "M13": _rate("refs", "known"), "M14": _rate("claims", "supported"), "M15": _rate("fields", "support"), "M16": _rate("fields", "support"),
    "M17": _rate("fields", "ok", "changed"), "M18": _rate("fields", "ok", "NOT changed"), "M19": _rate("fields", "stale AND NOT ok", "changed"), "M21": _rate("fields", "ok"),
    "M23": _rate("ev", "kind = 'worker_finished'", "kind IN ('worker_finished', 'worker_failed')"), "M24": _rate("atoms", "hit", "NOT before_hit"), "M25": _rate("fields", "ok", "field IN ('root_service', 'fault_type')"), "M26": _rate("fields", "ok"),
    "M27": "SELECT CAST(sum(c - 1) AS BIGINT) AS n, count(*) AS d FROM (SELECT count(*) AS c FROM \"rows\" GROUP BY result, key)", "M28": _rate("adoption", "adopted", "exposed"), "M29": _rate("adoption", "correct AND NOT adopted", "exposed"), "M30": _rate("spread", "inherited AND NOT checked"),
    "M32": _rate("confirmations", "NOT independent", "independent IS NOT NULL"), "M33": _rate("fields", "unsupported", "answered"), "M34": _rate("fields", "ok", "NOT unsupported"), "M35": _share("clean", "findings", "finding"), "M36": _share("required_checks", "run_checks", "check"),
    "M37": _rate("state", "difference IS NULL"), "M39": _rate("uncertain", "reconciled"), "M40": _rate("faults", "recovered", "exposed"), "M42": _rate("attempts", "status = 'SETTLED'"), "M48": _rate("deadlines", "met"),
}
_UPDATE = "(SELECT min(monotonic_end) FROM ev WHERE kind = 'environment_update')"
#: metric -> a quantity.
_AMOUNTS = {
    "M20": f"SELECT sum(calls + 1) FROM ev WHERE monotonic_start >= {_UPDATE}", "M22": f"SELECT min(monotonic_start) - {_UPDATE} FROM ev WHERE kind = 'manager_decision_started' AND monotonic_start >= {_UPDATE}",
    "M31": "SELECT count(DISTINCT root) FROM roots", "M38": "SELECT count(*) FROM state WHERE difference IN ('changed', 'unexpected')", "M41": "SELECT sum(calls + 1) FROM ev", "M43": "SELECT sum(CASE WHEN status = 'SETTLED' THEN cost ELSE reserved END) FROM attempts",
    "M44": "SELECT count(DISTINCT s) FROM (SELECT unnest(range(CAST(monotonic_start AS BIGINT), CAST(monotonic_end AS BIGINT))) AS s FROM ev WHERE kind IN ('model_completed', 'tool_completed'))",
    "M45": "SELECT avg((work_a - work_b) / nullif(work_a, 0)) FROM pair", "M46": "SELECT avg((time_a - time_b) / nullif(time_a, 0)) FROM pair", "M47": "SELECT count(*) FILTER (success) * (count(*) FILTER (success) - 1) / (count(*) * (count(*) - 1)) FROM repeats",
}
_WITH = "WITH " + ", ".join(f'"{"ev" if k == "events" else k}" AS (SELECT {columns} FROM {source})' for k, (source, columns) in _TABLES.items())
_SQL = " UNION ALL ".join(
    [f"SELECT '{m}' AS metric, CAST(n AS BIGINT) AS numerator, CAST(d AS BIGINT) AS denominator, round(n / d, 6) AS value, 'MEASURED' AS status FROM ({sql})" for m, sql in _RATES.items()]
    + [f"SELECT '{m}', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), round(CAST(({sql}) AS DOUBLE), 6), 'MEASURED'" for m, sql in _AMOUNTS.items()]
)


@query("q_metrics_of_an_episode", f"{_WITH} {_SQL}")
def metrics_of_an_episode(spark, sf_dir):
    tables = {}
    for name, (source, columns) in _TABLES.items():
        tables[name] = t(spark, sf_dir, source).selectExpr(*_split(columns.replace('"', "`")))
    delta = F.create_map(F.lit("calls"), F.col("calls"), F.lit("steps"), F.lit(1.0))
    tables["events"] = tables["events"].withColumn("resource_delta", delta)
    return M.registry(tables).select("metric", "numerator", "denominator", F.round("value", 6).alias("value"), "status")


def _split(columns: str) -> list[str]:
    """The expressions of a list of columns; commas within brackets do not part them."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(columns[at:i].strip())
            at = i + 1
    return [*out, columns[at:].strip()]


_EPISODE = """WITH fields AS (SELECT CAST(doc_id AS VARCHAR) AS field, quality = 1 AS ok, toxic = 1 AS changed, false AS stale, quality = 1 AS support, false AS unsupported, true AS answered FROM labels),
expected AS (SELECT doc_id AS id FROM documents), returned AS (SELECT doc_id AS id FROM labels)"""


def _registry_sql() -> str:
    rows = []
    for m, (needs, _) in M.DEFINITIONS.items():
        head = f"SELECT '{m}' AS metric, '{M.NAMES[m]}' AS name, "
        if set(needs) <= {"fields", "expected", "returned"}:
            rows.append(f"{head} CAST(n AS BIGINT) AS numerator, CAST(d AS BIGINT) AS denominator, round(CASE WHEN d > 0 THEN n / d END, 6) AS value, CASE WHEN d > 0 THEN 'MEASURED' ELSE 'NOT_APPLICABLE' END AS status FROM ({_RATES[m]})")
        else:
            rows.append(f"{head} CAST(NULL AS BIGINT) AS numerator, CAST(NULL AS BIGINT) AS denominator, CAST(NULL AS DOUBLE) AS value, 'NOT_OBSERVED' AS status")
    return f"{_EPISODE} " + " UNION ALL ".join(rows)


@query("q_metric_registry", _registry_sql())
def metric_registry(spark, sf_dir):
    """All 48 metrics of an episode made of documents: required are all, returned the labelled. What
    needs tables that the episode does not have is not observed."""
    docs, labels = t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels")
    fields = labels.select(F.col("doc_id").cast("string").alias("field"), (F.col("quality") == 1).alias("ok"), (F.col("toxic") == 1).alias("changed"), F.lit(False).alias("stale"), (F.col("quality") == 1).alias("support"), F.lit(False).alias("unsupported"), F.lit(True).alias("answered"))
    out = M.registry({"fields": fields, "expected": docs.select(F.col("doc_id").alias("id")), "returned": labels.select(F.col("doc_id").alias("id"))})
    return out.withColumn("value", F.round("value", 6))
