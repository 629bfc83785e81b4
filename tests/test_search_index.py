"""The search index against the search without one, and what it reads."""

from __future__ import annotations

import random

import pytest

from regatta.operators import catalog, search_index
from regatta.operators.search_index import SearchIndex


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    words = ["the"] * 8 + ["ring", "red", "river"] + [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 20, 200])))) for i in range(400)]
    rows += [(1000 + i, "The red, RED ring!") for i in range(30)] + [(2000, None), (2001, ""), (2002, "--")]
    return spark.createDataFrame(rows, "id bigint, text string").repartition(4)


def by_hand(docs, query, k):
    found = catalog.relevance(docs.fillna("", ["text"]), query, "id", "text").collect()
    return [(r.id, round(r.score, 9)) for r in sorted(found, key=lambda r: (-round(r.score, 9), r.id))[:k]]


@pytest.mark.parametrize("block", [8, 4096])
def test_the_best_are_those_of_a_full_scan(spark, docs, tmp_path, monkeypatch, block):
    monkeypatch.setattr(search_index, "BLOCK", block)
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=16).build(docs, "id", "text")
    for query, k in (("red ring", 7), ("the river", 1000), ("w3 w4 nowhere", 1)) if block == 8 else (("RED the", 7),):
        got = index.search(query, k).collect()
        assert [(r.key, round(r.score, 9)) for r in sorted(got, key=lambda r: r["rank"])] == by_hand(docs, query, k)
    assert index.search("nowhere at-all", 5).count() == 0


def test_a_search_reads_the_buckets_of_its_words(spark, docs, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=16).build(docs, "id", "text")
    lists = index.lists_of(["red", "ring"])
    plan = lists._jdf.queryExecution().executedPlan().toString()
    buckets = {r.bucket for r in lists.select("bucket").distinct().collect()}
    assert len(buckets) <= 2 and "PartitionFilters: [" in plan and "PushedFilters: [In(word" in plan
    read = {r.file_path for r in lists.select("_metadata.file_path").distinct().collect()}
    assert read and all(any(f"bucket={b}/" in f for b in buckets) for f in read)


def test_blocks_that_cannot_win_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", 16)
    rows = [(i, "red") for i in range(20)] + [(100 + i, "red " + "x " * 500) for i in range(200)]
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=4).build(spark.createDataFrame(rows, "id bigint, text string"), "id", "text")
    read = []
    scored = SearchIndex.scored

    def noted(self, query, blocks=None):
        read.append(blocks.count())
        return scored(self, query, blocks)

    monkeypatch.setattr(SearchIndex, "scored", noted)
    assert [r.key for r in index.search("red", 3).orderBy("rank").collect()] == [0, 1, 2]
    assert read[-1] <= 3 < index.lists_of(["red"]).count()


def test_an_empty_index(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index")).build(spark.createDataFrame([], "id bigint, text string"), "id", "text")
    assert index.search("red", 3).count() == 0


def test_texts_are_read_once(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(text):
        read.add(1)
        return text

    SearchIndex(spark, str(tmp_path / "index"), buckets=4).build(docs.withColumn("text", noted("text")), "id", "text")
    assert read.value == docs.count()


def test_lists_that_run_over_batches_are_whole(spark, docs, tmp_path):
    from regatta.streaming.session import settings

    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "3"}):
        index = SearchIndex(spark, str(tmp_path / "index"), buckets=4).build(docs, "id", "text")
    lists = index.lists_of(["red", "the"])
    assert lists.count() == lists.select("word", "block").distinct().count() < lists.selectExpr("explode(entries)").count() / 10
    assert lists.where("held <> size(entries)").count() == 0
    assert [(r.key, round(r.score, 9)) for r in index.search("red the", 9).orderBy("rank").collect()] == by_hand(docs, "red the", 9)
