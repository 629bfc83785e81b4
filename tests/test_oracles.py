"""Every query with oracle SQL returns what DuckDB returns; the others return rows where the tables give cause."""

from __future__ import annotations

import pytest

from regatta.plans.catalog import ORACLE_SQL, QUERIES
from tests.conftest import ROOT, same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, duck, small, name):
    same_rows(QUERIES[name](spark, small), duck.sql(ORACLE_SQL[name]))


#: Queries on the invented documents, which cite no law and have neither headings nor obligations (their twins on rules' texts find
#: some), and on cycles, of which the smallest table has none.
NOTHING_THERE = {"g03_cycles_whole", "n08_citations", "n09_sections", "n15_extracted_requirements"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, small, name):
    rows = QUERIES[name](spark, small)
    keys = [c for c in ("doc_id", "page_id", "event_id", "requirement_id", "root", "query_id") if c in rows.columns]
    found = rows.collect()
    assert (len(found) == 0) == (name in NOTHING_THERE)
    assert all(r[c] is not None for r in found for c in keys)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_queries_load_without_a_session():
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
