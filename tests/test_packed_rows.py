"""What the stream operators that take rows in order send to and from Python, and what becomes of rows that come late."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from regatta.streaming import ordered
from tests.test_state_calls import MADE, States, events, passed
from tests.test_streams import EVENTS, START, in_batches


class Values(States):
    """Counts the values that are handed to the list state."""

    def __init__(self):
        super().__init__()
        self.values = 0

    def getListState(self, name, schema):  # noqa: N802
        state, handle = super().getListState(name, schema), self

        class Counted(type(state)):
            def appendList(self, rows):  # noqa: N802
                handle.values += len(rows)
                super().appendList(rows)

        return Counted(self, name, [])


@pytest.mark.parametrize("name", MADE)
def test_rows_of_a_key_are_kept_by_the_hundred(name):
    handle, processor = Values(), MADE[name]()
    processor.init(handle)
    list(processor.handleInputRows((1,), iter(reversed(events(25_050))), None))
    assert handle.values == 251 and handle.timers[-1] == min(handle.timers)
    assert [r[1] for *_, text in sorted(handle.kept["pending"]) for r in json.loads(text)] == list(range(25_050))


@pytest.mark.parametrize("name", MADE)
def test_rows_as_texts_give_what_rows_give(name):
    rows = events(400)
    texts = [{"entity_id": 1, "ts": None, "row": json.dumps(r)}.values() for r in rows]
    of = lambda found: [r.asDict() for r in found[0]]
    assert of(passed(ordered.Texts(MADE[name]()), texts, range(0, 40_001, 350))) == of(passed(MADE[name](), rows, [40_000]))


@pytest.mark.parametrize("make", [lambda e: ordered.limited(e, 3, 60), lambda e: ordered.alerts(e, 1000, 30)])
def test_three_columns_of_a_row_reach_python(spark, tmp_path, make):
    spark.createDataFrame([], EVENTS).write.parquet(str(tmp_path / "in"))
    plan = make(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")))._jdf.queryExecution().analyzed().toString()
    call = next(line for line in plan.splitlines() if "transformWithStateUDF" in line)
    assert call.split("transformWithStateUDF(")[1].split(")")[0].count("#") == 3


def test_scores_that_are_null_and_types_with_quotes_pass_and_late_rows_do_not(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    rows = [(2**60 + 1, 1, "score.calculated", at(2), 9900), (2**60, 1, "score.calculated", at(1), 4000), (5, 1, "score.calculated", at(3), None)]
    rows += [(6, 1, "score.calculated", at(4), 4000), (7, 1, 'a "quoted", type', at(4), 1), (8, 1, "violation.detected", at(5), None)]
    closing = [(90, 2, "violation.detected", at(600), None), (91, 2, "violation.detected", at(601), None)]
    late = [(9, 1, "violation.detected", at(40), None), (99, 2, "violation.detected", at(1200), None)]
    got = in_batches(spark, tmp_path, rows + closing + late, (6, 1, 1, 2), lambda e: ordered.alerts(e, 1000, 30))
    # The first score is the lower one, so none falls; after a null score none does either.
    assert sorted((r.event_id, r.entity_id, r.rule, r.severity) for r in got.collect()) == [(8, 1, "violation", "critical"), (90, 2, "violation", "critical")]
