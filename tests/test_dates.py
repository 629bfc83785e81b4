"""Days in free text against a parser of another make."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from regatta.functions.dates import day_in, fuzzy_date

FORMS = [
    "%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y%m%d", "%m/%d/%Y", "%m-%d-%Y", "%d %B %Y", "%d %b %Y", "%B %d, %Y", "%b %d, %Y", "%B %d %Y", "%b. %d, %Y", "%A, %d %B %Y",
    "%d-%b-%Y", "%Y %b %d", "%Y-%m-%dT%H:%M:%S", "%B %d, %Y %I:%M %p", "%a %b %d %H:%M:%S %Y", "%b/%d/%Y", "%d. %B %Y",
]


def test_two_hundred_forms_agree_with_another_parser():
    parser = pytest.importorskip("dateutil.parser")
    rng = random.Random(9)
    cases = []
    for form in FORMS:
        for _ in range(12):
            day = dt.datetime(1970, 1, 1) + dt.timedelta(days=rng.randrange(25000), seconds=rng.randrange(86400))
            cases.append(day.strftime(form))
    assert len(set(cases)) > 200
    for text in cases:
        for full in (text, f"in force on {text} for all"):
            assert day_in(full) == parser.parse(full, fuzzy=True).date(), full


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("the 3rd of May, 2018", (2018, 5, 3)), ("May 1st 2018", (2018, 5, 1)), ("25/5/2018", (2018, 5, 25)), ("5/6/2018", (2018, 5, 6)), ("5/6/18", (2018, 5, 6)),
        ("31 Dec 99", (1999, 12, 31)), ("Sept 4, 2001", (2001, 9, 4)), ("2018-25-05", (2018, 5, 25)), ("7 MAI 2018", None), ("May 2018", None), ("30 February 2018", None),
        ("2018", None), ("1 2", None), ("", None), ("no day at all", None), ("May 5, 2018 or May 6, 2018", None), ("99999999", None), ("march 32 2018", None),
    ],
)
def test_days(text, day):
    assert day_in(text) == (day and dt.date(*day))


def test_day_first():
    assert day_in("5/6/2018", day_first=True) == dt.date(2018, 6, 5) and day_in("2018-06-05", day_first=True) == dt.date(2018, 6, 5)


def test_a_column_of_days(spark):
    rows = spark.createDataFrame([(1, "5 May 2018"), (2, None), (3, "x"), (4, "5 May 2018")], "i int, t string").repartition(2)
    got = {r.i: r.d for r in rows.select("i", fuzzy_date(F.col("t")).alias("d")).collect()}
    assert got == {1: dt.date(2018, 5, 5), 2: None, 3: None, 4: dt.date(2018, 5, 5)}
