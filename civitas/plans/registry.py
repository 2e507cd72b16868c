"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from civitas.plans import extraction, records, summaries  # noqa: F401  registers their queries
from civitas.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
