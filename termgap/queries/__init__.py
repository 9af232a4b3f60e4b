"""Registered queries over the provided tables, with their oracle statements."""

from termgap.queries import inputs, mining, outputs, scalars, terms  # noqa: F401  (registers the queries)
from termgap.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
