"""All registered queries."""

from placemetrics.queries import files, operators, report, surveys  # noqa: F401  (they register queries)
from placemetrics.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
