"""Severity of changes behind the start of a text."""

from __future__ import annotations

from regatta.operators import documents as dc
from regatta.plans.catalog import QUERIES


def test_changes_behind_the_start_count(spark):
    start = "a b c d " * 100
    old = spark.createDataFrame([(1, start), (2, start + "e f"), (3, start)], "doc_id bigint, text string")
    new = spark.createDataFrame([(1, start + "penalty"), (2, start + "g h i j"), (3, start + "x")], "doc_id bigint, text string")
    assert {r.doc_id: r.severity for r in dc.version_diff(old, new).collect()} == {1: "critical", 2: "high", 3: "low"}


def test_every_added_penalty_is_critical(spark, small):
    rows = QUERIES["n18_version_diff_whole"](spark, small).where("change_type = 'modified'").collect()
    assert rows and {r.severity for r in rows} == {"critical"}
