"""Queries: operators bound to the test tables, each with its SQL where SQL can express it."""

from tarn.plans import aggregates, analytics, filters, relations, scalars
from tarn.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aggregates", "analytics", "filters", "relations", "scalars"]
