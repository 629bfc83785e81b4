"""Days in free text, by a small grammar over tokens.

A text is read as numbers and words.  Words are months, ordinals of days or
fillers; numbers are years, months or days by their size, their neighbours and
the order in which they stand.  What is left over is resolved in one place:

* a number of four digits, or one above 31, is the year; without one the last
  of three numbers is, with the century that lies nearest to the pivot;
* eight digits in a row are year, month and day;
* a number with st, nd, rd or th, or above 12, is the day;
* of two numbers that may be either, the first is the month, unless the year
  stands first in ISO order or ``day_first`` is set.

A text gives a day only if year, month and day are all told and exist; other
words around a date do not matter, other numbers do.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Numbers (with an ordinal's ending) and words; clock times and zones are passed over as a whole.
TOKEN = re.compile(r"(?P<time>\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:[ap]\.?m\b\.?)?)|(?P<number>\d+)(?P<ordinal>(?:st|nd|rd|th)\b)?|(?P<word>[^\W\d_]+)", re.I)
#: The year around which two digits are read: 50 years back, 49 ahead.
PIVOT = 2025


def month_of(word: str) -> int | None:
    """Number of a month by its name or the beginning of it, of three letters at least."""
    low = word.lower()
    return next((i for i, m in enumerate(MONTHS, 1) if len(low) >= 3 and m.startswith(low)), 9 if low == "sept" else None)


def _full_year(year: int, digits: int) -> int:
    if digits > 2:
        return year
    century = PIVOT // 100 * 100 + year
    return century - 100 if century >= PIVOT + 50 else century + 100 if century < PIVOT - 50 else century


def _day(year: int, month: int, day: int) -> dt.date | None:
    try:
        return dt.date(year, month, day)
    except ValueError:
        return None


def day_in(text: str, day_first: bool = False) -> dt.date | None:
    """The day that a text tells."""
    month, numbers = None, []  # numbers: (value, digits, is an ordinal)
    for m in TOKEN.finditer(text.replace("T", " ") if re.search(r"\d[Tt]\d", text) else text):
        if m["number"]:
            numbers.append((int(m["number"]), len(m["number"]), bool(m["ordinal"])))
        elif m["word"] and month is None:
            month = month_of(m["word"])
    if len(numbers) == 1 and numbers[0][1] == 8 and month is None:
        value = numbers[0][0]
        return _day(value // 10_000, value // 100 % 100, value % 100)
    years = [i for i, (value, digits, ordinal) in enumerate(numbers) if not ordinal and (digits == 4 or (digits < 4 and value > 31))]
    wanted = 2 if month else 3
    if len(numbers) != wanted or len(years) > 1:
        return None
    at = years[0] if years else wanted - 1
    if numbers[at][2]:  # an ordinal is no year
        at = 0
    year = _full_year(*numbers[at][:2])
    rest = [n for i, n in enumerate(numbers) if i != at]
    if month:
        return _day(year, month, rest[0][0])
    (first, _, first_ordinal), (second, _, second_ordinal) = rest
    iso = at == 0 and bool(years)
    day_leads = first > 12 or first_ordinal or (day_first and not iso and second <= 12 and not second_ordinal)
    return _day(year, second, first) if day_leads else _day(year, first, second)


def fuzzy_date(text: Column, day_first: bool = False) -> Column:
    """The day that each text tells; null for none, for one that does not exist and for a null text.

    Texts repeat much in columns of dates, so a batch resolves each of its
    different texts once.
    """

    @F.pandas_udf("date")
    def resolved(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = {t: day_in(t, day_first) for t in texts.dropna().unique()}
            yield texts.map(lambda t: known.get(t))

    return resolved(text)
