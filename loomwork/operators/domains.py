"""Domain queries as DataFrame functions: sales and loans, telemetry, checks, business state."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.compare import ratio, saturating_difference
from loomwork.plans.types import TypeFault


def money(c: Column) -> Column:
    """Exact sums of amounts, however the rows are spread."""
    return c.cast("decimal(18,4)")


def to_cents(c: Column) -> Column:
    """A sum rounded to two decimals, half up."""
    return F.round(c, 2).cast("double")


# --- sales and loans -----------------------------------------------------------------------------
def customer_summary(rows: DataFrame, key: str, amount: str, date: str, prefix: str) -> DataFrame:
    """(key, n, total) of rows whose date text starts with prefix."""
    chosen = rows.where(F.col(date).cast("string").startswith(prefix))
    return chosen.groupBy(key).agg(F.count(F.lit(1)).alias("n"), to_cents(F.sum(money(F.col(amount)))).alias("total"))


def loan_summary(loans: DataFrame, accounts: DataFrame, districts: DataFrame) -> DataFrame:
    """(region, n, total, adverse) where adverse sums loans of status B or D."""
    rows = loans.join(accounts, "account_id").join(districts, "district_id")
    adverse = F.sum(F.when(F.col("status").isin("B", "D"), money(F.col("amount"))).otherwise(F.lit(0).cast("decimal(18,4)")))
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), to_cents(F.sum(money(F.col("amount")))).alias("total"), to_cents(adverse).alias("adverse"))


def purchase_summary(headers: DataFrame, lines: DataFrame, discount: bool = True) -> DataFrame:
    """(customer, orders, quantity, total) over headers (order_id, customer) and lines."""
    price = F.col("price") * F.col("quantity") * ((1 - F.col("discount")) if discount else F.lit(1.0))
    rows = headers.join(lines, "order_id")
    return rows.groupBy("customer").agg(F.countDistinct("order_id").alias("orders"), F.sum("quantity").alias("quantity"), to_cents(F.sum(money(price))).alias("total"))


def playlist_summary(songs: DataFrame, nested: bool = False) -> DataFrame:
    """(playlist, songs, duration) and, if asked for, the songs themselves in order of id."""
    aggregates = [F.count(F.lit(1)).alias("songs"), F.sum("duration").alias("duration")]
    if nested:
        aggregates.append(F.sort_array(F.collect_list(F.struct("id", "duration"))).alias("items"))
    return songs.groupBy("playlist").agg(*aggregates)


def merge_partials(parts: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Certified partial aggregates added up."""
    return parts.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def policy_class(value: Column, threshold: Column) -> Column:
    return F.when(threshold.isNull(), "unsupported").when(value >= threshold, "high").otherwise("low")


# --- telemetry -----------------------------------------------------------------------------------
def wide_metrics(df: DataFrame, time: str, contains: str = "", prefix: str = "") -> DataFrame:
    """(time, metric, value) of the metric columns whose name matches."""
    names = [c for c in df.columns if c != time and contains in c and c.startswith(prefix)]
    if not names:
        raise TypeFault("no metric matches")
    return df.select(F.col(time).alias("time"), *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["time"], names, "metric", "value")


def metric_summary(rows: DataFrame, cut) -> DataFrame:
    """(metric, pre, post, ratio): means before and from the cut; missing ratios rank as 0."""
    early = F.col("time") < F.lit(cut)
    out = rows.groupBy("metric").agg(F.avg(F.when(early, F.col("value"))).alias("pre"), F.avg(F.when(~early, F.col("value"))).alias("post"))
    return out.withColumn("ratio", ratio(F.col("post"), F.col("pre")))


def by_ratio(df: DataFrame, name: str) -> DataFrame:
    return df.orderBy(F.coalesce("ratio", F.lit(0.0)).desc(), name)


def trace_summary(spans: DataFrame, cut_ms) -> DataFrame:
    """(service, pre, post, ratio, n): median durations before and from the cut."""
    early = F.col("start_ms") < F.lit(cut_ms)
    out = spans.groupBy("service").agg(F.median(F.when(early, F.col("duration"))).alias("pre"), F.median(F.when(~early, F.col("duration"))).alias("post"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("ratio", ratio(F.col("post"), F.col("pre")))


def log_search(logs: DataFrame, pattern: str, service: str = "service", message: str = "message") -> DataFrame:
    """(service, n) of messages that match a regular expression, whatever the case."""
    re.compile(pattern)
    return logs.where(F.col(message).rlike(f"(?i){pattern}")).groupBy(service).agg(F.count(F.lit(1)).alias("n"))


def trace_relations(spans: DataFrame, n: int | None = None, null_matches_null: bool = False) -> DataFrame:
    """(parent, service, operation, n): calls by parent service; spans without parent keep null.
    The most frequent n where asked for."""
    p = spans.select(F.col("trace_id").alias("__t"), F.col("span_id").alias("__s"), F.col("service").alias("parent"))
    same = spans["parent_id"].eqNullSafe(F.col("__s")) if null_matches_null else spans["parent_id"] == F.col("__s")
    rows = spans.join(p, (spans["trace_id"] == F.col("__t")) & same, "left")
    out = rows.groupBy("parent", "service", "operation").agg(F.count(F.lit(1)).alias("n"))
    return out if n is None else out.orderBy(F.desc("n"), "parent", "service", "operation").limit(n)


def service_catalog(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


# --- checks --------------------------------------------------------------------------------------
def run_checks(observed: DataFrame, contracts: DataFrame) -> DataFrame:
    """(check_id, case_id, observed, expected, passed) for every contracted case; a case that was
    not observed has not passed."""
    rows = contracts.join(observed, ["check_id", "case_id"], "left")
    return rows.select("check_id", "case_id", "observed", "expected", F.coalesce(F.col("observed") == F.col("expected"), F.lit(False)).alias("passed"))


# --- business state ------------------------------------------------------------------------------
def download(have: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Idempotent insert: the new set, and what it changed."""
    changes = wanted.distinct().join(have, wanted.columns, "left_anti")
    return have.unionByName(changes), changes


def request_payments(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """(member, amount) after all requests: the one of the highest seq replaces the others."""
    rows = ledger.select("member", "amount", F.lit(-1).cast("long").alias("seq")).unionByName(requests.select("member", "amount", F.col("seq").cast("long").alias("seq")))
    return rows.groupBy("member").agg(F.max_by("amount", "seq").alias("amount"))


def payment_gaps(ledger: DataFrame) -> DataFrame:
    """(id, due) of members who have paid less than their share, in cents."""
    due = saturating_difference(F.col("share_cents"), F.col("paid_cents"))
    return ledger.select("id", due.alias("due")).where("due > 0")


def choose_playlist(playlists: DataFrame, least: int) -> DataFrame:
    """The playlist to play: the shortest one of at least so much, ties by id."""
    return playlists.where(F.col("duration") >= least).orderBy("duration", "playlist").limit(1)


def latest_per(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def column_key(name: str) -> str:
    """A column's name without case and punctuation."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def numeric_text(c: Column) -> Column:
    """A number from text that is exactly one, else null."""
    return F.when(c.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?$"), c.try_cast("double"))


def normalized(c: Column, names: dict[str, str]) -> Column:
    """Aliases to one spelling; unknown values stay."""
    key = F.lower(F.trim(c))
    out = c
    for alias, name in names.items():
        out = F.when(key == alias.lower(), F.lit(name)).otherwise(out)
    return out


# --- state and scoped checks -----------------------------------------------------------------------
def using(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An equi join that keeps one copy of the keys; null keys match nothing."""
    return left.join(right, keys)


def log_samples(logs: DataFrame, pattern: str, n: int, order: list[str], service: str = "service", message: str = "message") -> DataFrame:
    """(service, n, message): the first n matching messages of each service, numbered. The n least
    by order are picked with a partial aggregate, so a talkative service is not gathered."""
    re.compile(pattern)
    found = logs.where(F.col(message).rlike(f"(?i){pattern}")).select(service, F.struct(*order, F.col(message).alias("__m")).alias("__r"))
    salted = found.withColumn("__s", F.pmod(F.xxhash64("__r"), F.lit(64)))
    w = Window.partitionBy(service, "__s").orderBy("__r")
    few = salted.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    firsts = few.groupBy(service).agg(F.slice(F.sort_array(F.collect_list("__r")), 1, n).alias("__f"))
    return firsts.select(service, F.posexplode("__f").alias("__p", "__r")).select(service, (F.col("__p") + 1).alias("n"), F.col("__r.__m").alias(message))


def case_contracts(observed: DataFrame, contracts: DataFrame, cases: DataFrame) -> DataFrame:
    """The checks that fail, of the cases in scope alone."""
    scoped = contracts.join(cases.select("case_id").distinct(), "case_id", "left_semi")
    return run_checks(observed, scoped).where("not passed").drop("passed")


def payment_records(ledger: DataFrame, member=None, least: float | None = None, status: str | None = None) -> DataFrame:
    """The ledger's rows that pass all filters given."""
    out = ledger
    for column, value, compare in (("member", member, "__eq__"), ("amount", least, "__ge__"), ("status", status, "__eq__")):
        if value is not None:
            out = out.where(getattr(F.col(column), compare)(value))
    return out


def read_state(writes: DataFrame, keys: list[str], order: str, version: str, upto) -> DataFrame:
    """The snapshot after all writes of versions up to one: the last write of each key."""
    row = F.struct(*writes.columns)
    return writes.where(F.col(version) <= upto).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(row, F.col(order)).alias("__r")).select("__r.*")


def play(state: DataFrame, commands: DataFrame) -> DataFrame:
    """(session, playlist) after the commands (session, playlist, at): a session's last one wins,
    ties by the larger playlist; sessions without commands stay."""
    last = commands.groupBy("session").agg(F.max(F.struct("at", "playlist")).alias("__c"))
    return state.join(last, "session", "left").select("session", F.coalesce(F.col("__c.playlist"), F.col("playlist")).alias("playlist"))
