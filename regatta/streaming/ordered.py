"""Stateful stream operators that see the rows of a key in order of event time.

A micro-batch holds the rows of a key in any order, and later ones may hold
earlier rows.  ``InOrder`` keeps rows in a list state until the watermark has
passed them, when nothing earlier can come any more, and then hands them on in
order of time and id.  So a stream gives what a batch over the same rows
gives, however they arrived within the watermark's delay.

Every call to a state is a message to the JVM and its answer, so the state of
a key is read once for all rows that are handed on together, and kept once.
Every value in a state, and every column of a row that comes from the JVM, is
converted on its own, so a row comes as one JSON text (``Texts``) and up to
``PACKED`` rows are one text in the list state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from regatta.operators.scoring import ZK_TIERS
from regatta.streaming.monitor import LATE, RULES

#: Rows that are handed to the state store at a time.
APPENDED = 10_000
#: Rows that are one value of the list state.
PACKED = 100


def packed(rows: list[tuple]) -> list[tuple[int, int, str]]:
    """Rows in order as values of the list state: time and id of the first of at most ``PACKED`` rows, and all of them."""
    parts = (rows[i : i + PACKED] for i in range(0, len(rows), PACKED))
    return [(*part[0][:2], json.dumps(part, separators=(",", ":"))) for part in parts]


class InOrder(StatefulProcessor):
    """Keeps rows until the watermark passes them and takes a ``step`` with each in turn.

    Rows start with ``us`` (event time in microseconds) and ``event_id``;
    ``columns`` is the schema of what is kept of them.  ``opened`` makes
    the states of a subclass, ``loaded`` reads what a key has in them,
    ``step`` changes that, and ``settled`` keeps or drops it and may set a timer.
    """

    columns = "us bigint, event_id bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in self.columns.split(", ")]
        self.row, self.values = Row(*self.names), itemgetter(*self.names)
        self.pending = handle.getListState("pending", "us bigint, event_id bigint, rows string")
        self.opened(handle)

    def opened(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def loaded(self) -> dict:
        """What the states hold of the key."""
        raise NotImplementedError

    def step(self, key, row: Row, state: dict) -> Iterator[Row]:
        raise NotImplementedError

    def settled(self, state: dict, passed: int) -> None:
        """Called when all rows up to ``passed`` (microseconds) have had their step."""
        raise NotImplementedError

    def wake(self, us: int) -> None:
        """Set a timer for when the watermark reaches a time."""
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = None
        while part := sorted(map(self.values, islice(rows, APPENDED)), key=lambda r: r[:2]):
            self.pending.appendList(packed(part))
            first = part[0][0] if first is None else min(first, part[0][0])
        if first is not None:
            self.wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((r for *_, text in self.pending.get() for r in json.loads(text)), key=lambda r: r[:2])
        ready = [r for r in rows if r[0] <= passed]
        if len(ready) < len(rows):
            self.pending.put(packed(rows[len(ready) :]))
            self.wake(rows[len(ready)][0])
        elif rows:
            self.pending.clear()
        state = self.loaded()
        for values in ready:
            yield from self.step(key, self.row(*values), state)
        self.settled(state, passed)

    def close(self) -> None:
        pass


class Texts(StatefulProcessor):
    """A processor in order whose rows come as JSON texts in the last column."""

    def __init__(self, taken: InOrder):
        self.taken = taken

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken.init(handle)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        return self.taken.handleInputRows(key, (json.loads(text) for *_, text in rows), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        return self.taken.handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def close(self) -> None:
        self.taken.close()


#: What a step gives of a row; made by place, as names for every row cost more than the row.
ANSWERED, ALERTED = Row("event_id", "entity_id", "us", "allowed"), Row("event_id", "entity_id", "us", "rule", "severity")


class RateLimit(InOrder):
    """A fixed window of requests that opens with its first one; a timer closes it and empties its state."""

    def __init__(self, per_window: int, seconds: int):
        self.per_window, self.length = per_window, seconds * 1_000_000

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "opened bigint, used bigint")

    def loaded(self) -> dict:
        opened, used = self.window.get() or (None, 0)
        return {"opened": opened, "used": used}

    def step(self, key, row: Row, state: dict) -> Iterator[Row]:
        if state["opened"] is None or row.us - state["opened"] >= self.length:
            state |= {"opened": row.us, "used": 0}
        state["used"] += 1
        yield ANSWERED(row.event_id, key[0], row.us, state["used"] <= self.per_window)

    def settled(self, state: dict, passed: int) -> None:
        if state["opened"] is None:
            return
        end = state["opened"] + self.length
        if end <= passed:
            self.window.clear()
        else:
            self.window.update((state["opened"], state["used"]))
            self.wake(end)


class AlertRules(InOrder):
    """An entity's last score and, per rule, its last alert, which mutes those of the next minutes."""

    columns = "us bigint, event_id bigint, event_type string, score bigint"

    def __init__(self, drop: int, minutes: float):
        self.drop, self.mute = drop, int(minutes * 60_000_000)

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.score = handle.getValueState("score", "score bigint")
        self.last = handle.getMapState("last", "rule string", "us bigint")

    def loaded(self) -> dict:
        last = {rule[0]: us[0] for rule, us in self.last.iterator()}
        score = (self.score.get() or (None,))[0]
        return {"score": score, "last": last, "kept": (score, dict(last))}

    def hits(self, row: Row, state: dict) -> Iterator[str]:
        """Rules that an event meets, and the score it leaves behind."""
        if row.event_type == "violation.detected":
            yield "violation"
        if row.event_type == "score.calculated":
            before, now = state["score"], row.score
            state["score"] = now
            if before is not None and now is not None:
                if now - before < -self.drop:
                    yield "score_drop"
                if tier_of(now) > tier_of(before):
                    yield "tier_downgrade"

    def step(self, key, row: Row, state: dict) -> Iterator[Row]:
        for rule in self.hits(row, state):
            before = state["last"].get(rule)
            if before is None or row.us - before >= self.mute:
                state["last"][rule] = row.us
                yield ALERTED(row.event_id, key[0], row.us, rule, RULES[rule])

    def settled(self, state: dict, passed: int) -> None:
        """Alerts that mute nothing any more are forgotten; the last score stays, the next one is compared with it."""
        score, last = state["kept"]
        if state["score"] != score:
            self.score.update((state["score"],))
        mutes = {rule: us for rule, us in state["last"].items() if us + self.mute > passed}
        for rule, us in mutes.items():
            if last.get(rule) != us:
                self.last.updateValue((rule,), (us,))
        for rule in last.keys() - mutes.keys():
            self.last.removeKey((rule,))
        if mutes:
            self.wake(min(mutes.values()) + self.mute)


def tier_of(score: int) -> int:
    """``scoring.zk_tier`` of one score."""
    return next((tier for least, tier in ZK_TIERS if score >= least), len(ZK_TIERS) + 1)


def _in_order(events: DataFrame, processor: InOrder, out: str) -> DataFrame:
    """What a processor makes of each entity's events; rows without time, id or entity have no place in an order and are left out."""
    known = events.where("ts is not null and event_id is not null and entity_id is not null")
    timed = known.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).withColumn("us", F.unix_micros("ts"))
    columns = [c.split()[0] for c in processor.columns.split(", ")]
    texts = timed.select("entity_id", "ts", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row"))
    return texts.groupBy("entity_id").transformWithState(Texts(processor), out, "append", "EventTime")


def limited(events: DataFrame, per_window: int = 100, seconds: int = 60) -> DataFrame:
    """``monitor.limited`` on a stream: whether each request is within the limit of its entity's window.

    A request is answered when the watermark has passed it.  Start it with
    RocksDB as the state store (``session.settings``), as ``monitor.drained`` does.
    """
    rows = _in_order(events, RateLimit(per_window, seconds), "event_id bigint, entity_id bigint, us bigint, allowed boolean")
    return rows.select("event_id", "entity_id", F.timestamp_micros("us").alias("ts"), "allowed")


def alerts(events: DataFrame, drop: int = 1000, minutes: float = 60) -> DataFrame:
    """``monitor.alerts`` on a stream of events in any order within the watermark's delay."""
    watched = events.where("event_type in ('violation.detected', 'score.calculated')").withColumn("score", F.col("score").cast("bigint"))
    rows = _in_order(watched, AlertRules(drop, minutes), "event_id bigint, entity_id bigint, us bigint, rule string, severity string")
    return rows.select("event_id", "entity_id", F.timestamp_micros("us").alias("ts"), "rule", "severity")
