"""Read-only SQL over registered views: one SELECT, guarded, paged, with a deadline."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from loomwork.plans.types import TypeFault

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*$")
#: What a read-only query may consist of, and functions that reach outside it.
NODES = {
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Sample",
    "Sort", "SubqueryAlias", "Tail", "Union", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "Unpivot", "Window", "WithWindowDefinition",
}
OUTSIDE = {
    "reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "version", "current_user", "user", "session_user", "current_catalog",
    "current_database", "current_schema", "raise_error", "assert_true",
}


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def _parts(plan):
    """All nodes and expressions of a parsed plan, those of subqueries and common tables included."""
    todo = [plan]
    while todo:
        x = todo.pop()
        name = x.getClass().getSimpleName()
        yield name, x
        todo += _seq(x.children())
        if ".plans." in x.getClass().getName() or name.startswith("Unresolved") and name[10:] in ("With", "Having", "Relation", "InlineTable", "SubqueryColumnAliases"):
            todo += _seq(x.expressions())
            todo += [k for k in _seq(x.innerChildren())]
        elif "Subquery" in name or name in ("Exists", "ListQuery"):
            todo.append(x.query() if name == "InSubquery" else x.plan())


def guard(spark: SparkSession, text: str, views: list[str]) -> DataFrame:
    """The query as a DataFrame if it only reads the given views. The parsed plan decides, before
    anything is looked up: it may hold nodes of NODES alone, every relation must be one of the views
    or a common table of the query, and every function one of Spark's own that stays inside."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    relations, functions, common = set(), set(), set()
    for name, x in _parts(parsed):
        if any(p in x.getClass().getName() for p in (".plans.", ".execution.")) and name not in NODES:
            raise TypeFault(f"SQL_READ_ONLY {name}")
        if name == "UnresolvedRelation":
            relations.add(".".join(_seq(x.multipartIdentifier())))
        elif name == "UnresolvedWith":
            common |= {n for r in _seq(x.cteRelations()) if not spark.catalog.tableExists(n := r._1())}  # none may hide a table
        elif name == "UnresolvedFunction":
            functions.add(".".join(_seq(x.nameParts())).lower())
        elif name in ("UnresolvedTableValuedFunction", "RelationTimeTravel", "PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier"):
            raise TypeFault(f"SQL_READ_ONLY {name}")
    if relations - set(views) - common:
        raise TypeFault(f"SQL_RELATION {sorted(relations - set(views) - common)}")
    own = {r[0] for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()}
    if outside := functions & OUTSIDE | functions - own:
        raise TypeFault(f"SQL_FUNCTION {sorted(outside)}")
    return spark.sql(text)


def relations(df: DataFrame) -> set[str]:
    """The views that the analysed plan reads."""
    analysed, found = df._jdf.queryExecution().analyzed(), set()
    todo = [analysed]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() in ("SubqueryAlias", "View"):
            name = node.identifier().name() if node.getClass().getSimpleName() == "SubqueryAlias" else node.desc().identifier().table()
            kids = node.children()
            inner = kids.apply(0).getClass().getSimpleName() if kids.size() else ""
            if node.getClass().getSimpleName() == "View" or inner == "View":
                found.add(name)
        for group in (node.children(), node.innerChildren()):
            todo += [group.apply(i) for i in range(group.size()) if hasattr(group.apply(i), "children")]
    return found


def select(spark: SparkSession, text: str, views: list[str], limit: int = 1000, offset: int = 0, timeout: float = 20.0) -> dict:
    """One page of at most 1000 rows: columns, rows, whether more follow, the next offset, and the
    views read. The job is cancelled at the deadline."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise TypeFault("PARAMETER_RANGE")
    df, tag = guard(spark, text, views), f"sql-{uuid.uuid4().hex}"
    timer = threading.Timer(timeout, lambda: spark.interruptTag(tag))
    spark.addTag(tag)
    timer.start()
    try:
        rows = df.offset(offset).limit(limit + 1).collect()
    finally:
        timer.cancel()
        spark.removeTag(tag)
    more = len(rows) > limit
    return {"columns": df.columns, "rows": [list(r) for r in rows[:limit]], "has_more": more, "next_offset": offset + limit if more else None, "tables": sorted(relations(df))}


def explain(spark: SparkSession, text: str, views: list[str]) -> str:
    return guard(spark, text, views)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def row_lookup(spark: SparkSession, view: str, column: str, value) -> DataFrame:
    """Rows whose column equals the value; names must be plain identifiers."""
    from pyspark.sql import functions as F

    if not IDENTIFIER.match(view) or not IDENTIFIER.match(column):
        raise TypeFault("SQL_IDENTIFIER")
    return spark.table(view).where(F.col(column) == F.lit(value))
