"""Selection by rank, the embedding cache, and tables that are changed by key."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from regatta.operators import embedding, selection
from regatta.sources.keyed_table import KeyedTable


def by_hand(values, p):
    ordered = sorted(values)
    return ordered[min(len(ordered) * p // 100, len(ordered) - 1)] if len(ordered) * p // 100 < len(ordered) else None


@pytest.mark.parametrize("ranked", [5, 1_000_000])
def test_percentiles_by_narrowing_and_by_ranking(spark, monkeypatch, ranked):
    monkeypatch.setattr(selection, "RANKED", ranked)
    monkeypatch.setattr(selection, "PARTS", 4)
    rng = random.Random(6)
    own = {"many": [rng.gauss(0, 1e6) for _ in range(900)], "same": [3.0] * 50, "few": [1.0, 2.0, 2.0, 9.0], "one": [7.5]}
    own["skew"] = [10.0 ** rng.randrange(-300, 300) for _ in range(300)] + [0.0] * 400
    rows = [(k, v) for k, vs in own.items() for v in vs] + [("many", None), ("none", None)]
    points = (0, 1, 50, 95, 99)
    got = selection.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(3), "k", "v", points).collect()
    assert {(r.k, r.p): (r.percentile, r.n, r.least, r.most) for r in got} == {(k, p): (by_hand(vs, p), len(vs), min(vs), max(vs)) for k, vs in own.items() for p in points}


def test_a_key_with_only_different_values_is_in_no_window(spark, monkeypatch):
    monkeypatch.setattr(selection, "RANKED", 20)
    rows = spark.range(5000).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 5003).alias("v"))
    seen = []
    ranked = selection._ranked

    def noted(counts, asked):
        seen.append(counts.groupBy("key").count().agg(F.max("count")).first()[0] or 0)
        return ranked(counts, asked)

    monkeypatch.setattr(selection, "_ranked", noted)
    got = selection.percentiles(rows, "k", "v", (50,)).first()
    values = sorted(i * 7919 % 5003 for i in range(5000))
    assert got.percentile == values[2500] and max(seen) <= 20


class Counting:
    """A provider that writes down what it was asked for."""

    def __init__(self, folder: Path):
        self.folder = folder
        folder.mkdir(exist_ok=True)

    def __call__(self, texts: list[str]) -> list[list[float]]:
        (self.folder / f"{random.getrandbits(64):x}").write_text("\n".join(texts))
        return [[float(len(t)), float(t.count("a"))] for t in texts]

    def calls(self) -> list[list[str]]:
        return [f.read_text().split("\n") for f in self.folder.iterdir()]


def test_each_text_is_embedded_once(spark, tmp_path):
    provider = Counting(tmp_path / "calls")
    cache = embedding.EmbeddingCache(spark, str(tmp_path / "cache"), "m1")
    texts = [(i, f"text a{i % 40}") for i in range(400)] + [(900, None), (901, ""), (902, "a" * 70)]
    docs = spark.createDataFrame(texts, "id int, text string").repartition(3)
    for _ in range(2):  # the second run asks for nothing
        got = {r.id: r for r in embedding.embedded(docs, provider, cache, batch=7, longest=50).collect()}
        asked = provider.calls()
        assert sorted(t for call in asked for t in call) == sorted({t[:50] for _, t in texts if t is not None}) and max(map(len, asked)) <= 7
    assert len(got) == 403 and got[900].embedding is None and got[900].text_hash is None
    assert got[3].embedding == [7.0, 1.0] and got[902].embedding == [50.0, 50.0] and got[901].embedding == [0.0, 0.0]
    assert got[902].text_hash == hashlib.md5(b"a" * 70).hexdigest()
    more = docs.union(spark.createDataFrame([(1000, "new")], docs.schema))
    assert embedding.embedded(more, provider, cache).count() == 404
    assert sum(map(len, provider.calls())) == 43
    other = embedding.EmbeddingCache(spark, str(tmp_path / "cache"), "m2")  # another model asks anew
    embedding.embedded(more.where("id = 1000"), provider, other).collect()
    assert sum(map(len, provider.calls())) == 44


def test_a_provider_that_loses_texts_fails(spark, tmp_path):
    cache = embedding.EmbeddingCache(spark, str(tmp_path / "cache"), "m")
    with pytest.raises(Exception, match="got 0"):
        embedding.embedded(spark.createDataFrame([("x",)], "text string"), lambda texts: [], cache).collect()


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(200).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"), F.lit(None).cast("int").alias("n"))
    return KeyedTable(spark, str(tmp_path / "table"), ("id",), "id bigint, v string, n int", buckets=8).create(rows)


def files(table):
    return {str(f.relative_to(table.path)) for f in Path(table.path).glob("bucket=*/*.parquet")}


def content(table):
    return {r.id: (r.v, r.n) for r in table.read().collect()}


def test_an_upsert_rewrites_touched_buckets_only(spark, table):
    before, expected = files(table), content(table)
    new = spark.createDataFrame([(3, "three", 1), (1000, "new", None)], "id bigint, v string, n int")
    touched = {r.b for r in new.select(F.pmod(F.xxhash64("id"), F.lit(8)).alias("b")).collect()}
    table.upsert(new)
    assert content(table) == expected | {3: ("three", 1), 1000: ("new", None)}
    kept = {f for f in before if int(f.split("/")[0].removeprefix("bucket=")) not in touched}
    assert kept and kept <= files(table) and not (before - kept) & files(table)


def test_updates_deletes_and_buckets_that_become_empty(spark, table):
    expected = content(table)
    table.update(spark.createDataFrame([(5, 9), (7777, 1)], "id bigint, n int"))
    expected[5] = ("v5", 9)
    assert content(table) == expected
    table.update(spark.createDataFrame([(5, None, None)], "id bigint, v string, n int"))
    assert content(table) == expected
    gone = [r.id for r in table.read().where("pmod(xxhash64(id), 8) = 2 or id < 10").select("id").collect()]
    table.delete(spark.createDataFrame([(i,) for i in gone], "id bigint"))
    assert content(table) == {k: v for k, v in expected.items() if k not in gone}
    table.upsert(spark.createDataFrame([], "id bigint, v string, n int"))
    assert len(content(table)) == 200 - len(gone)


def test_an_append_adds_what_passes_its_checks(spark, table):
    before = files(table)
    rows = [(500, "ok", 1), (501, None, 1), (502, "x", -1), (3, "old key", 1), (600, "twice", 1), (600, "twice", 2)]
    bad = table.append(spark.createDataFrame(rows, "id bigint, v string, n int"), ("no value", "v is not null"), ("below zero", "n >= 0"))
    assert sorted((r.id, r.reason) for r in bad.collect()) == [(3, "key exists"), (501, "no value"), (502, "below zero"), (600, "key exists"), (600, "key exists")]
    assert content(table)[500] == ("ok", 1) and len(content(table)) == 201 and before < files(table)
