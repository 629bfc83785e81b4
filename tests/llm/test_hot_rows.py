"""One key with a third of all rows, ids that repeat without end, and columns that cannot be ordered."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from regatta.llm import labelled, lookup, simhash, vector_dedup

DOCS = "doc_id bigint, text string"


@pytest.fixture
def few_hubs(monkeypatch):
    """Keys of four rows are hubs already."""
    monkeypatch.setattr(lookup, "MANY", 3)
    monkeypatch.setattr(lookup, "HUBS", 1000)


def plain(spark, monkeypatch, make):
    """The result with hubs apart, and without."""
    with_hubs = sorted(map(tuple, make().collect()), key=repr)
    monkeypatch.setattr(lookup, "MANY", 1 << 40)
    return with_hubs, sorted(map(tuple, make().collect()), key=repr)


def test_copies_of_a_text(spark, few_hubs, monkeypatch):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(i, text(0)) for i in range(30)] + [(100 + i, text(i)) for i in range(40)] + [(None, text(0)), (500, None), (501, ""), (502, " ")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    hubs, expected = plain(spark, monkeypatch, lambda: simhash.simhash_groups(docs).select("doc_id", "fingerprint", "component_id"))
    assert hubs == expected and len(hubs) == len(rows)
    assert {r[2] for r in hubs if r[0] is not None and r[0] < 30} == {0} and {r[2] for r in hubs if r[0] in (500, 501, 502)} == {500}


def test_copies_of_a_vector_and_one_large_component(spark, few_hubs, monkeypatch):
    rng = np.random.default_rng(4)
    chain = [[float(np.cos(a)), float(np.sin(a)), 0.0] for a in np.linspace(0, 1.2, 30)]  # each links with its neighbours
    rows = [(i, v) for i, v in enumerate(chain)] + [(100 + i, [0.0, 0.0, 1.0]) for i in range(25)] + [(200 + i, rng.normal(size=3).tolist()) for i in range(10)]
    rows += [(300, None), (301, [0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    hubs, expected = plain(spark, monkeypatch, lambda: vector_dedup.vector_links(table, 0.99))
    assert hubs == expected and len(hubs) == len(rows)
    by_id = {r[0]: r for r in hubs}
    assert {by_id[i][2] for i in range(30)} == {0} and by_id[110][1] >= 24


def test_a_labelled_id_on_many_rows_is_read_once(spark):
    docs = spark.range(3000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.union(spark.createDataFrame([(3, "a b c"), (3, "a b c"), (4, None), (None, "x")], DOCS)).repartition(3)
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (4, 0), (None, 1), (8, 1)], "doc_id bigint, toxic int")
    same = lambda windows: windows
    got = labelled.fitted(labelled.sample_windows(docs, labels, F.col("toxic"), re.compile(r"\S+"), False, {0: 5, 1: 5}, width=64, most=3), same)
    held = [i for i in (1, 3, 4) if spark.range(1).select(labelled.held_out(F.lit(i))).first()[0]]
    assert sorted(got["doc_id"]) == [i for i in (1, 3, 4) if i not in held]
    again = labelled.fitted(labelled.sample_windows(docs.repartition(5), labels, F.col("toxic"), re.compile(r"\S+"), False, {0: 5, 1: 5}, width=64, most=3), same)
    assert again.equals(got)


def test_near_copies_with_columns_that_have_no_order(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "en", "s", {"k": 2}), (1, text, "en", "s", {"k": 1}), (2, text, "de", "t", None), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, extra map<string,int>")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, text, "en", "s", {"k": 1}), (3, None, None, None, None)]
