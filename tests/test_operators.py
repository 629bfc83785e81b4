"""Operators against small hand-made or brute-force cases."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from regatta.functions import text as tx
from regatta.operators import applicability as ap
from regatta.operators import documents as dc
from regatta.operators import catalog, graph, mutations, scoring
from regatta.sources import domain
from regatta.streaming import changes, monitor


def test_scores_of_the_standard_sample(spark):
    rows = [
        ("e", "r1", "compliant", "basic", "low"), ("e", "r2", "compliant", "basic", "low"), ("e", "r3", "non_compliant", "standard", "medium"),
        ("e", "r4", "partial", "standard", "medium"), ("e", "r5", "not_applicable", "advanced", "high"),
    ]
    items = spark.createDataFrame(rows, "entity string, requirement string, status string, tier string, risk_impact string")
    got = scoring.item_scores(items, "entity").first()
    assert (got.total, got.simple_score, got.weighted_score, got.risk_adjusted_score) == (4, 0.625, 0.55, round(2.6 / 4.4, 6))
    assert got.risk_level == "high"


def test_null_risk_weighs_one_and_empty_gives_nothing(spark):
    items = spark.createDataFrame([("e", "partial", None, None)], "entity string, status string, tier string, risk_impact string")
    assert scoring.item_scores(items, "entity").first().weighted_score == 0.5
    assert scoring.item_scores(items.limit(0), "entity").count() == 0


def test_tier_of_the_contradictory_sample_follows_the_rules(spark):
    rows = [("sme", 10, 500000.0, ["US"], ["RETAIL"], None)]
    schema = "entity_type string, employee_count int, annual_revenue double, jurisdictions array<string>, sectors array<string>, risk_factors map<string,boolean>"
    got = scoring.recommended_tier(spark.createDataFrame(rows, schema)).first()
    assert (got.tier, got.confidence, got.risk, got.risk_level) == ("standard", 0.7, 2.5, "medium")


def test_rewritten_applicability_equals_the_literal_condition(spark, small):
    e, r = domain.entities(spark, small), domain.requirements(spark, small)
    fast, slow = ap.applicable(e, r), ap.applicable_theta(e, r)
    assert fast.exceptAll(slow).count() == 0 and slow.exceptAll(fast).count() == 0
    assert "NestedLoop" not in fast._jdf.queryExecution().executedPlan().toString()


def test_reachability_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src bigint, dst bigint")
    roots = spark.createDataFrame([(1,), (4,)], "root bigint")
    got = {(r.root, r.node): r.depth for r in graph.reachable(edges, roots, 10).collect()}
    assert got == {(1, 2): 1, (1, 3): 2, (1, 1): 3, (1, 4): 3}
    assert graph.cycles(edges, roots).collect()[0].cycle_length == 3


def test_shortest_path(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4)], "src bigint, dst bigint")
    got = graph.shortest_paths(edges, spark.createDataFrame([(3,), (9,)], "root bigint"), 1).collect()
    assert [(r.root, r.hops, r.path) for r in got] == [(3, 2, [3, 2, 1])]


def test_citations(spark):
    text = "Under 45 CFR 164.502, pursuant to 42 U.S.C. § 1234 and Regulation (EU) 2016/679."
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(tx.citations(F.col("t"))).alias("c")).select("c.*").collect()
    got = {(r.type, r.identifier, r.section) for r in rows}
    assert {("cfr", "45", "164.502"), ("us_code", "42", "1234"), ("eu_regulation", "2016/679", None)} <= got


def test_cleaning(spark):
    raw = "A  b\t c ,d\r\n\n\n\nPage 3 of 9\nend"
    got = spark.createDataFrame([(raw,)], "t string").select(tx.cleaned(F.col("t"))).first()[0]
    assert "Page" not in got and got.startswith("A b c, d") and "\n\n\n" not in got


def test_headers_are_removed(spark):
    text = "\n".join(["Official Journal of X" if i % 5 == 0 else f"line {i}" for i in range(30)])
    docs = spark.createDataFrame([(1, text), (2, "Official Journal of X\n" * 5)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in dc.without_headers(docs).collect()}
    assert "Journal" not in got[1] and "line 29" in got[1] and "Journal" in got[2]


def test_diff_and_severity(spark):
    schema = "doc_id bigint, text string"
    old = spark.createDataFrame([(1, "a b c d"), (2, "same"), (3, "gone")], schema)
    new = spark.createDataFrame([(1, "a b c d with penalty"), (2, "same"), (4, "fresh")], schema)
    got = {r.doc_id: (r.change_type, r.severity) for r in dc.version_diff(old, new).collect()}
    assert got == {1: ("modified", "critical"), 3: ("deleted", "medium"), 4: ("new", "high")}


def test_mutations(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id bigint, v string, deleted_at timestamp")
    up = mutations.upserted(base, spark.createDataFrame([(2, "B", None), (3, "c", None)], base.schema), ["id"])
    assert sorted((r.id, r.v) for r in up.collect()) == [(1, "a"), (2, "B"), (3, "c")]
    gone = mutations.soft_deleted(base, F.col("id") == 1, F.lit(dt.datetime(2024, 1, 1)))
    assert [r.id for r in gone.where("deleted_at is null").collect()] == [2]


def test_cooldown():
    assert monitor.cooled([0, 10, 3599, 3600, 7300]) == [True, False, False, True, True]


def test_change_stream_reports_new_then_modified(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    for i, rows in enumerate(([("a", "1"), ("b", "1")], [("a", "1"), ("b", "2")])):
        spark.createDataFrame(rows, "key string, content_hash string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("key string, content_hash string").parquet(str(source))
        monitor.drained(changes.detected_changes(stream), str(out), str(tmp_path / "state"), empty_batches=False)
        got = sorted((r.key, r.change_type) for r in spark.read.parquet(str(out)).collect())
        assert got == [("a", "NEW"), ("b", "NEW")] if i == 0 else [("a", "NEW"), ("b", "MODIFIED"), ("b", "NEW")]


def test_versions_of_one_batch_are_told_apart_by_their_time(spark, tmp_path):
    schema = "key string, content_hash string, at timestamp"
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [("a", "3", day(3)), ("a", "1", day(1)), ("a", "2", day(2)), ("b", "1", day(1)), ("a", "3", day(4)), ("a", "0", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    monitor.drained(changes.detected_changes(stream, at="at"), str(tmp_path / "out"), str(tmp_path / "state"), empty_batches=False)
    got = sorted((r.key, r.content_hash, r.change_type) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "0", "NEW"), ("a", "1", "MODIFIED"), ("a", "2", "MODIFIED"), ("a", "3", "MODIFIED"), ("b", "1", "NEW")]


def test_open_requirements_are_ranked_without_a_shuffle_of_pairs(spark):
    entities = spark.createDataFrame([(1, ["A"], ["x"]), (2, ["A", "B"], ["x", "y"]), (3, ["A"], ["x"]), (4, None, ["x"])], "entity_id int, jurisdictions array<string>, sectors array<string>")
    need = spark.createDataFrame(
        [(10, "basic", 5.0, ["A"], ["x"]), (11, "advanced", 1.0, ["A"], ["ALL"]), (12, "advanced", 9.0, ["B"], ["y"]), (13, "standard", None, ["ALL"], ["x"]),
         (14, None, 7.0, ["A"], ["x"]), (15, "basic", 5.0, None, ["x"])],
        "requirement_id int, tier string, penalty double, jurisdictions array<string>, sectors array<string>",
    )
    closed = spark.createDataFrame([(1, 11), (1, 14), (2, 12), (2, 99), (9, 10)], "entity_id int, requirement_id int")
    found = ap.open_requirements(entities, need, closed, "tier")
    expected = {(1, 13, "standard", 1), (1, 10, "basic", 2), (2, 11, "advanced", 1), (2, 13, "standard", 2), (2, 14, None, 3), (2, 10, "basic", 4)}
    expected |= {(3, 11, "advanced", 1), (3, 13, "standard", 2), (3, 14, None, 3), (3, 10, "basic", 4), (4, 13, "standard", 1)}
    assert {tuple(r) for r in found.collect()} == expected and found.count() == len(expected)
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Exchange" not in above and "Window" not in above


def test_ad_hoc_tables_leave_the_session_as_it_was(spark):
    spark.range(3).createOrReplaceTempView("mine")
    found = catalog.ad_hoc(spark, {"mine": spark.range(10), "other": spark.range(2)}, "select count(*) as n from mine, other where mine.id = other.id and mine.id < :most", {"most": 5})
    assert spark.table("mine").count() == 3 and not spark.catalog.tableExists("other") and found.first().n == 2
    spark.catalog.dropTempView("mine")
