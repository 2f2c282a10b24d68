"""All queries of the graph and event operators, and their DuckDB SQL."""

from __future__ import annotations

from graphloom.queries import documents, drawings, edits, graphs, large, logs, more, rich, runs, values  # noqa: F401
from graphloom.queries.registry import QUERIES, SQL

FLAGSHIP = "kpi_scorecard"
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
