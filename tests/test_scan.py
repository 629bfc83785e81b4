"""Scans over chunks against the scan over whole keys."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from regatta.operators import scan
from regatta.streaming import monitor

ROWS = "event_id bigint, entity_id bigint, ts timestamp, v string"


def made(n: int, seed: int, gap: int):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice([1] * 6 + [2, 3, 4, None]), start + dt.timedelta(seconds=rng.randrange(gap * n)), rng.choice(["a", "b", None])) for i in range(n)]
    return rows + [(n + i, 1, None, "late") for i in range(3)] + [(n + 9, 5, start, None)]


def test_previous_values_are_those_of_a_window(spark):
    rows = spark.createDataFrame(made(600, 1, 3), ROWS)
    window = Window.partitionBy("entity_id").orderBy("ts", "event_id")
    expected = rows.select("event_id", F.lag("v").over(window).alias("before"), F.row_number().over(window).cast("bigint").alias("turn"))
    got = scan.with_previous(rows, ["entity_id"], ["ts", "event_id"], {"before": "v", "before_id": "event_id"})
    assert sorted(map(tuple, got.select("event_id", "before", "_turn").collect())) == sorted(map(tuple, expected.collect()))
    assert got.columns == [*rows.columns, "before", "before_id", "_turn"]


def test_a_key_with_most_rows_lies_in_several_chunks(spark):
    rows = spark.createDataFrame(made(600, 2, 3), ROWS)
    placed = scan.chunked(rows, F.to_json(F.struct("entity_id")), [F.col("ts"), F.col("event_id")])
    of_hot = placed.where("entity_id = 1").groupBy("_part").count().collect()
    assert len(of_hot) >= 2 and max(r["count"] for r in of_hot) < 600 * 0.5
    joins = scan.with_previous(rows, ["entity_id"], ["ts", "event_id"], {"before": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joins


def in_one_go(rows, step):
    out, states = {}, {}
    for i, entity, ts, _ in sorted(rows, key=lambda r: (r[2] is None, r[2] or dt.datetime.min, r[0])):
        t = float("-inf") if ts is None else ts.replace(tzinfo=dt.timezone.utc).timestamp()
        states[entity], out[i] = step(states.get(entity), t)
    return out


def test_turns_equal_a_scan_in_one_go(spark):
    def every_third(state, t):  # a state that never forgets: all chunks of a key depend on each other
        return ((state or 0) + 1) % 3, (state or 0) == 0

    def spaced(state, t):
        fires = state is None or t - state >= 50
        return (t if fires else state), fires

    for seed, gap in ((1, 3), (2, 40)):
        rows = made(500, seed, gap)
        df = spark.createDataFrame(rows, ROWS)
        for step in (every_third, spaced):
            got = {r.event_id: r.flag for r in scan.in_turn(df, ["entity_id"], step, "flag").collect()}
            assert got == in_one_go(rows, step)


def test_rounds_are_few_where_states_forget(spark):
    rows = spark.createDataFrame(made(800, 3, 30), ROWS).where("ts is not null").withColumn("_us", F.unix_micros("ts"))
    order = [F.asc_nulls_last("ts"), F.asc("event_id")]
    placed = scan.chunked(rows, F.to_json(F.struct("entity_id")), order)

    def spaced(state, t):
        fires = state is None or t - state >= 20
        return (t if fires else state), fires

    carried, rounds = scan.settled(placed, spaced, order)
    assert carried and rounds <= 3


def test_nothing_to_scan(spark):
    none = spark.createDataFrame([], ROWS)
    assert scan.in_turn(none, ["entity_id"], lambda s, t: (s, True), "flag").count() == 0
    assert scan.with_previous(none, ["entity_id"], ["ts"], {"before": "v"}).count() == 0
    assert monitor.limited(none).count() == 0
