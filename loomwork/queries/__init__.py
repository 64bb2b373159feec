"""Queries over the driver's tables, one per operator implementation, and their SQL."""

from __future__ import annotations

from loomwork.queries import analytics, documents, graphs, metrics, nested, relational, runtime
from loomwork.queries.base import ORACLE_SQL, QUERIES
from loomwork.queries.relational import flagship

__all__ = ["ORACLE_SQL", "QUERIES", "analytics", "documents", "flagship", "graphs", "metrics", "nested", "relational", "runtime"]
