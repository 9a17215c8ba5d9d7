"""The queries of the engine and the SQL that states their results, by name."""

from narrata.plans.catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
