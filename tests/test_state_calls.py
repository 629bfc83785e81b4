"""How often the stream operators that take rows in order call their states."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from regatta.streaming import ordered


class States:
    """A handle whose states are kept here; ``calls`` counts the messages that the JVM would get."""

    def __init__(self):
        self.calls, self.kept, self.timers = 0, {}, []

    def getListState(self, name, schema):  # noqa: N802
        return State(self, name, [])

    def getValueState(self, name, schema):  # noqa: N802
        return State(self, name, None)

    def getMapState(self, name, key, value):  # noqa: N802
        return State(self, name, {})

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.append(ms)


class State:
    def __init__(self, handle, name, empty):
        self.handle, self.name, self.empty = handle, name, empty

    def call(self, value=None, put=False):
        self.handle.calls += 1
        if put:
            self.handle.kept[self.name] = value
        return self.handle.kept.get(self.name, self.empty)

    def get(self):
        return self.call()

    def exists(self):
        return bool(self.call())

    def put(self, value):
        self.call(value, True)

    update = put

    def clear(self):
        self.call(self.empty, True)

    def appendList(self, rows):  # noqa: N802
        self.put([*self.handle.kept.get(self.name, []), *rows])

    def iterator(self):
        return iter(dict(self.call()).items())

    def getValue(self, key):  # noqa: N802
        return self.call().get(key)

    def containsKey(self, key):  # noqa: N802
        return key in self.call()

    def updateValue(self, key, value):  # noqa: N802
        self.put(self.handle.kept.get(self.name, {}) | {key: value})

    def removeKey(self, key):  # noqa: N802
        self.put({k: v for k, v in self.handle.kept.get(self.name, {}).items() if k != key})


def passed(processor, rows, marks):
    """What one key's rows give when the watermark stands at each of some times (seconds) in turn, and the handle."""
    handle = States()
    processor.init(handle)
    list(processor.handleInputRows((1,), iter(rows), None))
    out = []
    for mark in marks:
        out += processor.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m * 1000), None)
    return out, handle


def events(n):
    """An event every 100 seconds; scores fall from one to the next but every third time."""
    kinds = ["score.calculated", "score.calculated", "violation.detected", "score.calculated"]
    return [{"us": i * 100_000_000, "event_id": i, "event_type": kinds[i % 4], "score": [9900, 8000, None, 6000][i % 4]} for i in range(n)]


MADE = {"limited": lambda: ordered.RateLimit(3, 1000), "alerts": lambda: ordered.AlertRules(1000, 30)}


@pytest.mark.parametrize("name", MADE)
def test_calls_do_not_grow_with_the_rows_of_a_key(name):
    few, many = (passed(MADE[name](), events(n), [n * 100 - 50]) for n in (40, 4000))
    assert len(many[0]) > 50 * len(few[0]) > 0
    assert many[1].calls == few[1].calls < 20


@pytest.mark.parametrize("name", MADE)
def test_marks_in_between_change_nothing(name):
    rows = events(400)
    once, _ = passed(MADE[name](), rows, [40_000])
    often, handle = passed(MADE[name](), rows, range(0, 40_001, 350))
    assert once == often and len(once) > 30
    # The rows are gone from the state, and nothing that a later row could still need.
    assert not handle.kept["pending"] and (name == "limited" or handle.kept["score"] == (6000,))


def test_a_closed_window_and_a_spent_alert_leave_no_state():
    for name, state in (("limited", "window"), ("alerts", "last")):
        _, handle = passed(MADE[name](), events(40), [4_000, 20_000])
        assert not handle.kept[state] and max(handle.timers) <= 20_000_000
