"""Expressions over typed data compiled to Spark: columns (row-local) and tables (relational)."""

from arborq.plans.columns import column
from arborq.plans.tables import query

__all__ = ["column", "query"]
