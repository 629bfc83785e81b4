"""Compliance analytics as Spark jobs."""
