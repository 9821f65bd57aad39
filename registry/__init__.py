"""Queries run on given tables, each with the SQL that must give the same rows."""

from registry import file_queries  # noqa: F401
from registry.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
