"""All queries of the compliance engine by name, and their oracle SQL."""

from __future__ import annotations

from regatta.plans import assessing, completions, graphs, records, requirements, rules, streams, tables, texts, watching
from regatta.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "assessing", "completions", "graphs", "records", "requirements", "rules", "streams", "tables", "texts", "watching"]
