"""Queries of the core operators and the SQL they are compared with."""

from quarrystone.queries import graphs, links, ordered, relational, search, statistics, texts  # noqa: F401
from quarrystone.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
