"""All queries of the engine, and the SQL that gives the same rows."""

from . import queries_core, queries_more, queries_scan, queries_state, queries_stores  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
