"""All queries over the engine's own operators, with the SQL they are checked against."""

from __future__ import annotations

from . import star_queries

QUERIES: dict = star_queries.QUERIES
ORACLE_SQL: dict[str, str] = star_queries.ORACLE_SQL
