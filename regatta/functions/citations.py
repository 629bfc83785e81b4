"""Legal citations, recognised by a reader of tokens.

A text is read as numbers, words and signs.  A citation starts at a mark (the
letters of a code, the name of an act, a section word or sign); what follows a
mark is a number, read by one reader for all families, which differ only in
the separators between its parts and in what may stand around it.  Marks are
whole words in any case, their letters with or without full stops, so that
``PSI 2019/1`` is no instrument and ``Sections 4`` no section.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\d+|[^\W\d_]+|\S")
SECTION_SIGN = "§"
COMMUNITIES = ("eu", "ec")
TYPE = "array<struct<type:string,raw:string,identifier:string,section:string>>"


class Token(NamedTuple):
    low: str
    start: int
    end: int

    @property
    def is_number(self) -> bool:
        return self.low.isdecimal()


class Reader:
    """Steps over the tokens of a text; each step returns the place behind what it read, or None where it is not there."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [Token(m[0].lower(), *m.span()) for m in TOKEN.finditer(text)]

    def low(self, at: int) -> str:
        return self.tokens[at].low if 0 <= at < len(self.tokens) else ""

    def joined(self, at: int) -> bool:
        """Whether no white space stands before this token."""
        return 0 < at < len(self.tokens) and self.tokens[at - 1].end == self.tokens[at].start

    def number(self, at: int) -> int | None:
        return at + 1 if at < len(self.tokens) and self.tokens[at].is_number else None

    def word(self, at: int, *words: str) -> int | None:
        return at + 1 if self.low(at) in words else None

    def letters(self, at: int, name: str) -> int | None:
        """The letters of an abbreviation without gaps; full stops may stand behind any of them."""
        read, place = "", at
        while read != name:
            if read and not self.joined(place):
                return None
            if self.low(place) == "." and read:
                place += 1
            elif self.low(place) and name.startswith(read + self.low(place)):
                read += self.low(place)
                place += 1
            else:
                return None
        return place + 1 if self.low(place) == "." and self.joined(place) else place

    def parts(self, at: int, separators: str, most: int | None = None, letter: bool = False) -> int | None:
        """A number, further numbers behind separators, at most ``most`` in all; a single letter may stand behind the first."""
        place, count = self.number(at), 1
        if place is None:
            return None
        if letter and self.joined(place) and len(self.low(place)) == 1 and self.low(place).isalpha():
            place += 1
        while (most is None or count < most) and self.low(place) in tuple(separators) and self.joined(place) and self.joined(place + 1) and self.number(place + 1):
            place, count = place + 2, count + 1
        return place

    def brackets(self, at: int) -> int:
        """Behind the paragraphs in brackets that follow: (a)(1)(ii)."""
        while self.low(at) == "(" and self.joined(at):
            inside = at + 1
            while self.low(inside).isalnum() and self.joined(inside):
                inside += 1
            if inside == at + 1 or self.low(inside) != ")" or not self.joined(inside):
                break
            at = inside + 1
        return at

    def span(self, start: int, end: int) -> str:
        """The text of the tokens from ``start`` up to ``end``."""
        return self.text[self.tokens[start].start : self.tokens[end - 1].end]


#: What a family reads at a token: the place behind the citation, its identifier and its section, or None.
Found = tuple[int, str, str | None] | None


def _code(letters: str, separators: str, letter: bool) -> Callable[[Reader, int], Found]:
    """Title number, letters of the code, a section sign if there is one, and the section."""

    def read(r: Reader, at: int) -> Found:
        behind = r.number(at) and r.letters(at + 1, letters)
        if not behind:
            return None
        section = r.word(behind, SECTION_SIGN) or behind
        end = r.parts(section, separators, 2, letter)
        if end is None:
            return None
        end = r.brackets(end)
        return end, r.span(at, at + 1), r.span(section, end)

    return read


def _regulation(r: Reader, at: int) -> Found:
    behind = r.word(at, "regulation")
    behind = behind and r.word(behind, "(")
    behind = behind and r.word(behind, *COMMUNITIES)
    behind = behind and r.word(behind, ")")
    if not behind:
        return None
    number = r.word(behind, "no") or behind
    number = r.word(number, ".") or number if number > behind else number
    return _pair(r, number)


def _pair(r: Reader, at: int) -> Found:
    """Two numbers and a stroke between them."""
    end = r.parts(at, "/", 2)
    return (end, r.span(at, end), None) if end == at + 3 else None


def _directive(r: Reader, at: int) -> Found:
    pair = r.word(at, "directive") and _pair(r, at + 1)
    if not pair or r.low(pair[0]) != "/" or r.low(pair[0] + 1) not in COMMUNITIES:
        return None
    return pair[0] + 2, r.span(at + 1, pair[0] + 2), None


def _instrument(r: Reader, at: int) -> Found:
    behind = r.letters(at, "si")
    return _pair(r, behind) if behind else None


def _section(r: Reader, at: int) -> Found:
    number = r.word(at, "section", SECTION_SIGN)
    if number is None and r.word(at, "art", "article"):
        number = r.word(at + 1, ".") or at + 1
    end = r.parts(number, ".-") if number else None
    if end is None:
        return None
    end = r.brackets(end)
    return end, r.span(number, end), None


FAMILIES: dict[str, Callable[[Reader, int], Found]] = {
    "us_code": _code("usc", "-", letter=True),
    "cfr": _code("cfr", ".", letter=False),
    "eu_regulation": _regulation,
    "eu_directive": _directive,
    "uk_si": _instrument,
    "section": _section,
}


#: Words at which alone a citation of a family can be, and how many tokens stand before them in it.
MARKS: dict[str, tuple[frozenset[str], int]] = {
    "us_code": (frozenset(("u", "us", "usc")), 1),
    "cfr": (frozenset(("c", "cf", "cfr")), 1),
    "eu_regulation": (frozenset(("regulation",)), 0),
    "eu_directive": (frozenset(("directive",)), 0),
    "uk_si": (frozenset(("s", "si")), 0),
    "section": (frozenset(("section", SECTION_SIGN, "art", "article")), 0),
}
ALL_MARKS = frozenset().union(*(words for words, _ in MARKS.values()))


def found_in(text: str) -> Iterator[tuple[str, str, str, str | None]]:
    """(type, raw, identifier, section) of the citations of a text, family by family, those of one never overlapping."""
    reader = Reader(text)
    places = [(i, t.low) for i, t in enumerate(reader.tokens) if t.low in ALL_MARKS]
    for family, read in FAMILIES.items():
        at, (words, before) = 0, MARKS[family]
        for place, low in places:
            start = place - before
            if low in words and start >= at and (found := read(reader, start)):
                yield family, reader.span(start, found[0]), *found[1:]
                at = found[0]


def citations(text: Column) -> Column:
    """Array of (type, raw, identifier, section) of every citation, family by family; null for a null text.

    Which token follows which decides, not a pattern, hence a pandas function
    that sees each text by itself.
    """

    @F.pandas_udf(TYPE)
    def found(texts: pd.Series) -> pd.Series:
        fields = ("type", "raw", "identifier", "section")
        return texts.map(lambda t: None if t is None else [dict(zip(fields, c)) for c in found_in(t)])

    return found(text)
