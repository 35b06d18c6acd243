"""Queries over the test tables, each with SQL for the same rows."""

from quern.plans import documents, given, relational, scaled, searching, stored, windowed  # noqa: F401
from quern.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
