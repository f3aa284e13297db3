"""The queries of the library, by name."""

from wavecohort.jobs import base, group_tests, model_queries, networks, signals, tables

QUERIES, SQL = base.QUERIES, base.SQL
__all__ = ["QUERIES", "SQL", "base", "group_tests", "model_queries", "networks", "signals", "tables"]
