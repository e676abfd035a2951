"""Queries of the engine's own operators, by name, and their SQL."""

from .plans import core_queries

QUERIES: dict = dict(core_queries.QUERIES)
ORACLE: dict[str, str] = dict(core_queries.ORACLE)
