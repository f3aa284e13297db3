"""Spark jobs for signals, group tests and networks."""
