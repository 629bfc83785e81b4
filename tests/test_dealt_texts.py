"""Texts made from a small file are worked on by many tasks; claims beyond the largest score do not hold."""

from __future__ import annotations

import os

import pytest

from regatta.functions import citations
from regatta.plans.catalog import ORACLE_SQL, QUERIES
from regatta.sources import domain
from tests.conftest import same_rows


def test_legal_texts_are_dealt_to_tasks(spark, small):
    texts = domain.legal_texts(spark, small)
    assert texts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert texts.select("doc_id").distinct().count() == texts.count() == spark.read.parquet(f"{small}/part.parquet").count()


def test_citations_are_sought_at_marks_only(monkeypatch):
    tried = []
    monkeypatch.setitem(citations.FAMILIES, "us_code", lambda r, at, read=citations.FAMILIES["us_code"]: tried.append(at) or read(r, at))
    text = "one two 3 four " * 50 + "42 U.S.C. § 7 and 42 USC 8(a)"
    assert [c[2:] for c in citations.found_in(text) if c[0] == "us_code"] == [("42", "7"), ("42", "8(a)")]
    assert len(tried) == 2


@pytest.mark.parametrize("scores", [(-20, 4999, 5000, 10000, 10001, 99999)])
def test_claims_above_the_largest_score_are_invalid(spark, duck, small, tmp_path, scores):
    import duckdb

    con = duckdb.connect()
    rows = " union all ".join(f"select * replace (3::bigint as event_id, {s} / 20.0 as value) from e" for s in scores)
    con.sql(f"copy (with e as (select * from (select * from '{small}/events.parquet' limit 1)) {rows}) to '{tmp_path}/events.parquet'")
    for file in os.listdir(small):
        if file.endswith(".parquet"):
            place = tmp_path if file == "events.parquet" else small
            con.sql(f"create view {file[:-8]} as select * from read_parquet('{place}/{file}')")
    found = QUERIES["a22_batch_verification"](spark, str(tmp_path))
    assert tuple(found.first()) == ("threshold", 6, 2, 4)
    same_rows(found, con.sql(ORACLE_SQL["a22_batch_verification"]))
