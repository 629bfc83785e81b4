"""Operators that must not gather a whole group in one row or one call."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from regatta.operators import rml
from regatta.sources import domain
from regatta.streaming import monitor


def test_no_document_holds_a_whole_large_regulation(spark, small):
    need = domain.requirements(spark, small).withColumn("regulation_id", F.lit("one"))
    docs = rml.generated(need, size=20).collect()
    assert len(docs) > 1 and max(len(d.requirements) for d in docs) <= 60
    ids = [r.id for d in docs for r in d.requirements]
    assert len(ids) == len(set(ids)) == need.count() == docs[0].statistics.total


def test_unique_requirements_equal_first_wins_by_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for base in range(6):
        text = rng.sample(words, 25)
        for _ in range(12):
            own = list(text)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(25)] = rng.choice(words)
            rows.append((len(rows), None if base == 5 else f"r{base % 2}", " ".join(own)))
    rows += [(900, "r0", None), (901, "r0", ""), (902, "r0", "a b"), (903, "r0", "b a")]
    kept, expected = {}, set()
    for i, regulation, text in rows:
        own = set((text or "").split())
        if not any(own and k and len(own & k) / len(own | k) > 0.9 for k in kept.setdefault(regulation, [])):
            kept[regulation].append(own)
            expected.add((i, regulation))
    frame = spark.createDataFrame(rows, "requirement_id bigint, regulation_id string, natural_language string")
    got = rml.greedy_unique(frame)
    assert len(expected) < 60 and {(r.requirement_id, r.regulation_id) for r in got.collect()} == expected
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()


def test_limits_and_cooldowns_go_on_over_batches(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3 or None, start + dt.timedelta(seconds=7 * i), "violation.detected", 0) for i in range(300)]
    events = spark.createDataFrame(rows, "event_id bigint, entity_id bigint, ts timestamp, event_type string, score int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        limited, alerts = monitor.limited(events, 3, 100), monitor.alerts(events, minutes=5)
        allowed, fired = {r.event_id for r in limited.where("allowed").collect()}, {r.event_id for r in alerts.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert all("FlatMapGroups" not in x._jdf.queryExecution().executedPlan().toString() for x in (limited, alerts))
    expected, cooled = set(), set()
    for k in range(3):
        own = [i for i in range(300) if i % 3 == k]
        opened, used = None, 0
        for i in own:
            if opened is None or 7 * (i - opened) >= 100:
                opened, used = i, 0
            used += 1
            expected |= {i} if used <= 3 else set()
        cooled |= {i for i, fires in zip(own, monitor.cooled([7 * i for i in own], 5)) if fires}
    assert allowed == expected and fired == cooled
