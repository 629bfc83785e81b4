"""Streams with state against the batch over the same rows, replayed batches, and the record of streams."""

from __future__ import annotations

import datetime as dt
import random
import shutil
from pathlib import Path

import pytest

from regatta.streaming import changes, consume, monitor, ordered
from regatta.streaming.session import PROVIDER

START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
EVENTS = "event_id bigint, entity_id bigint, event_type string, ts timestamp, score bigint"


def made(n: int, minutes: float, seed: int):
    """Events of few entities, one of them with half of all, several at the same time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        entity = rng.choice([1, 1, 1, 2, 3, 4])
        kind = rng.choice(["score.calculated", "score.calculated", "violation.detected", "entity.created"])
        at = START + dt.timedelta(seconds=round(rng.uniform(0, minutes * 60)))
        rows.append((i, entity, kind, at, rng.choice([9900, 9000, 8000, 6000, 4000, None])))
    return rows


def in_batches(spark, tmp_path, rows, sizes, make):
    """The results of a stream that gets the rows in so many batches, drained after each."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = 0
    for size in sizes:
        spark.createDataFrame(rows[at : at + size], EVENTS).repartition(3).write.mode("append").parquet(source)
        at += size
        stream = spark.readStream.schema(EVENTS).parquet(source)
        monitor.drained(make(stream), out, str(tmp_path / "state"))
    return spark.read.parquet(out)


@pytest.mark.parametrize("name", ["limited", "alerts"])
def test_a_stream_in_any_order_gives_what_the_batch_gives(spark, tmp_path, name):
    rows = sorted(made(240, 120, 3), key=lambda r: r[3])
    # Arrival is late by up to eight minutes, and within a batch in any order.
    rng = random.Random(5)
    rows = sorted(rows, key=lambda r: r[3].timestamp() + rng.uniform(0, 480))
    closing = [(999, 9, "entity.created", START + dt.timedelta(hours=5), None)]
    calls = {
        "limited": (lambda e: ordered.limited(e, 3, 600), lambda e: monitor.limited(e, 3, 600), ("event_id", "entity_id", "allowed")),
        "alerts": (lambda e: ordered.alerts(e, 1000, 30), lambda e: monitor.alerts(e, 1000, 30), ("event_id", "entity_id", "rule", "severity")),
    }
    stream, batch, columns = calls[name]
    if name == "alerts":
        closing = [(999, 9, "violation.detected", START + dt.timedelta(hours=5), None)]
    got = in_batches(spark, tmp_path, rows + closing, (100, 140, 1), stream)
    expected = batch(spark.createDataFrame(rows, EVENTS))
    of = lambda df: sorted(tuple(r[c] for c in columns) for r in df.where("event_id <> 999").collect())
    assert of(got) == of(expected) and len(of(got)) > 20
    state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "pending")
    left = state.option("flattenCollectionTypes", "true").load()
    # Rows that the watermark has passed are gone from the state; the closing one still waits.
    assert {r.list_element.event_id for r in left.select("list_element").collect()} == {999}


def test_state_of_a_window_is_gone_when_it_has_closed(spark, tmp_path):
    rows = [(i, 1, "x", START + dt.timedelta(seconds=i), None) for i in range(4)] + [(9, 2, "x", START + dt.timedelta(hours=1), None)]
    got = in_batches(spark, tmp_path, rows, (4, 1), lambda e: ordered.limited(e, 3, 60))
    assert sorted((r.event_id, r.allowed) for r in got.collect()) == [(0, True), (1, True), (2, True), (3, False)]
    left = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "window").load()
    assert left.count() == 0
    assert spark.conf.get(PROVIDER, None) is None or "RocksDB" not in spark.conf.get(PROVIDER)


def test_tiers_of_one_score_are_those_of_the_column(spark):
    from pyspark.sql import functions as F

    from regatta.operators.scoring import zk_tier

    scores = [10000, 9500, 9499, 8500, 8499, 7000, 6999, 5000, 4999, 0]
    rows = spark.createDataFrame([(s,) for s in scores], "s int").select(zk_tier(F.col("s")).alias("t")).collect()
    assert [r.t for r in rows] == [ordered.tier_of(s) for s in scores] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def loop_of(tmp_path) -> consume.Loop:
    return consume.Loop(str(tmp_path / "good"), str(tmp_path / "bad"), "event_id bigint, kind string", ("event_id", "kind"))


def messages_in(spark, tmp_path):
    source = str(tmp_path / "topic")
    for part in range(4):  # one file each
        rows = [(f'{{"event_id":{part * 10 + i},"kind":"a"}}',) for i in range(5)] + [("{",), ('{"kind":"b"}',), (None,)]
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(source)


def test_a_replayed_batch_writes_nothing_twice(spark, tmp_path):
    loop, state = loop_of(tmp_path), tmp_path / "state"
    assert loop.run(messages_in(spark, tmp_path), str(state)) == 20
    last = max((f for f in Path(state, "commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    last.unlink()  # as if the driver had died between the writes and the commit
    Path(state, "commits", f".{last.name}.crc").unlink(missing_ok=True)
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "topic"))
    loop_of(tmp_path).run(stream, str(state))
    good = [r.event_id for r in spark.read.parquet(loop.handled).collect()]
    assert len(good) == len(set(good)) == 20
    bad = spark.read.parquet(loop.rejected)
    assert {(r.reason, r["count"]) for r in bad.groupBy("reason").count().collect()} == {("not JSON", 8), ("missing event_id", 4)}


def test_a_loop_stops_after_enough_messages_and_goes_on_later(spark, tmp_path):
    loop, state = loop_of(tmp_path), str(tmp_path / "state")
    stream = messages_in(spark, tmp_path)
    assert loop.run(stream, state, max_messages=6) == 10  # whole batches of five
    assert loop.run(stream, state, max_messages=100) == 10 and loop.run(stream, state) == 0
    assert spark.read.parquet(loop.handled).count() == 20


def test_a_handler_that_fails_leaves_its_batch_for_the_next_run(spark, tmp_path):
    loop, state, stream = loop_of(tmp_path), str(tmp_path / "state"), messages_in(spark, tmp_path)

    def broken(rows):
        raise RuntimeError("no such luck")

    loop.handle = broken
    with pytest.raises(Exception, match="no such luck"):
        loop.run(stream, state)
    loop.handle = lambda rows: rows.select("event_id")
    assert loop.run(stream, state) == 20 and spark.read.parquet(loop.handled).columns == ["event_id", "batch"]


def test_progress_is_recorded(spark, tmp_path):
    stream = messages_in(spark, tmp_path)
    with consume.recorded(spark, str(tmp_path / "progress")):
        monitor.drained(stream, str(tmp_path / "out"), str(tmp_path / "state"), name="told")
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
            monitor.drained(stream.selectExpr("1 div (length(value) - length(value)) as x"), str(tmp_path / "o2"), str(tmp_path / "s2"), name="fails")
    rows = spark.read.parquet(str(tmp_path / "progress")).collect()
    assert sum(r.rows for r in rows if r.name == "told") == 32 and len({r.batch_id for r in rows if r.name == "told"}) == 4
    assert [r.failed for r in rows if r.name == "fails"][-1] and not any(r.failed for r in rows if r.name == "told")
    assert monitor.progress_of([{"numInputRows": 2, "processedRowsPerSecond": 1.5, "latestOffset": {"t": {"0": 9, "1": 5}}, "endOffset": '{"t": {"0": 7, "1": 5}}'}]) == {
        "rows": 2, "rows_per_second": 1.5, "lag": 2,
    }


def test_unsubscribing_stops_a_running_stream(spark, tmp_path):
    query = messages_in(spark, tmp_path).writeStream.format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    told = monitor.progress(query)
    assert told["name"] == "running" and told["active"] and not told["failed"]
    assert consume.unsubscribed(spark, "running") and not query.isActive and not consume.unsubscribed(spark, "running")


def test_due_jobs(spark):
    from pyspark.sql import functions as F

    jobs = spark.createDataFrame([("a", 24, True), ("b", 24, True), ("c", 1, False), ("d", 1, True)], "id string, hours int, enabled boolean")
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    runs = spark.createDataFrame([("a", at(1, 0)), ("a", at(2, 12)), ("b", at(2, 13))], "id string, at timestamp_ntz")
    due = changes.due_jobs(jobs, runs, F.lit(at(3, 12)).cast("timestamp_ntz"))
    assert sorted(r.id for r in due.collect()) == ["a", "d"]
