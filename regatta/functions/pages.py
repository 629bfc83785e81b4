"""Text, titles, dates and identifiers of HTML pages, and formats of files.

Cleaning works piece by piece: a page is split before each ``<``, every piece
starts with a tag (or is plain text), and the tag's name says what stands for
it in the text.  All but the decoding of references are column expressions.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regatta.functions.text import stripped, text_by_text, unified_lines

#: What stands for a tag in plain text (fixed values); other tags leave nothing.
STANDS_FOR = {"br": "\n", "p": "\n\n", "li": "\n\u2022 "} | {f"h{i}": "\n\n" for i in range(1, 7)} | {f"/h{i}": "\n" for i in range(1, 7)}
#: Elements without text of the document, by kind of source.
GENERAL, EUROPEAN = ("script", "style"), ("script", "style", "nav", "footer")


def unescaped(text: Column) -> Column:
    """Character references decoded (no built-in function does this)."""
    return text_by_text(html.unescape)(text)


def plain_text(page: Column, without: tuple[str, ...] = GENERAL) -> Column:
    """Text of a page: breaks, paragraphs, headings and list items as line ends, other tags and the elements ``without`` as nothing.

    An element that is not closed stays in the text, as does a ``<`` that no
    ``>`` follows.  References are decoded after the tags have gone and before
    white space is folded.  Null gives null.
    """
    body = F.regexp_replace(page, rf"(?is)<({'|'.join(without)})\b[^>]*>.*?</\1>", "")
    known = F.create_map(*(F.lit(x) for pair in STANDS_FOR.items() for x in pair))

    def piece(x: Column) -> Column:
        tag = F.lower(F.regexp_extract(x, "^<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>", 1))
        return F.concat(F.coalesce(F.element_at(known, tag), F.lit("")), F.regexp_replace(x, "^<[^>]+>", ""))

    text = F.array_join(F.transform(F.split(body, "(?=<)"), piece), "")
    return stripped(unified_lines(unescaped(text)))


class _Reader(HTMLParser):
    """Texts of a page outside of passed-over elements, those of each main element apart."""

    PASSED = ("script", "style", "nav", "footer", "header", "aside")
    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    MAIN_CLASS = re.compile("content|main|body", re.I)

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []  # tag, kind of main element ("" for others)
        self.all: list[str] = []
        self.of: dict[str, list[str]] = {}
        self.done: set[str] = set()
        self.title: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.VOID:
            return
        kind = tag if tag in ("main", "article") else "div" if tag == "div" and self.MAIN_CLASS.search(dict(attrs).get("class") or "") else ""
        if kind in self.of or any(t in self.PASSED for t, _ in self.open):
            kind = ""  # the first of its kind counts
        if kind:
            self.of[kind] = []
        self.open.append((tag, kind))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while True:
                name, kind = self.open.pop()
                self.done |= {kind}
                if name == tag:
                    break

    def handle_data(self, data: str) -> None:
        text = data.strip()
        names = [t for t, _ in self.open]
        if "title" in names and self.title is None:
            self.title = text
        if text and not any(t in self.PASSED for t in names):
            self.all.append(text)
            for kind, own in self.of.items():
                if kind not in self.done:
                    own.append(text)

    def text(self) -> str:
        for kind in ("main", "article", "div"):
            if kind in self.of:
                return "\n".join(self.of[kind])
        return "\n".join(self.all)


def main_content(page: str | None) -> tuple[str | None, str | None]:
    """Title and text of a page: of its first ``main``, else ``article``, else content ``div``, else of the whole page."""
    if page is None:
        return None, None
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return reader.title, re.sub(" {2,}", " ", reader.text())


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
def page_content(pages: pd.Series) -> pd.DataFrame:
    """Title and main text of pages, each text between tags on a line of its own."""
    return pd.DataFrame([main_content(p) for p in pages], columns=["title", "text"])


def page_title(page: Column) -> Column:
    """Title element without the publisher's prefix, else the first heading; null if there is neither."""
    inside = lambda tag: stripped(F.nullif(F.regexp_extract(page, rf"(?i)<{tag}\b[^>]*>([^<]+)</{tag}>", 1), F.lit("")))
    return F.coalesce(F.regexp_replace(inside("title"), r"^EUR-Lex\s*[-\u2013]\s*", ""), inside("h1"))


def page_date(page: Column) -> Column:
    """The first day like 31.12.2020 or 31/12/2020, else like 2020-12-31, in the first 5000 characters (a rule of the pipeline).

    A day that does not exist gives way to the next form.
    """
    head = F.substring(page, 1, 5000)
    day_first = F.regexp_replace(F.regexp_extract(head, r"\d{1,2}[./]\d{1,2}[./]\d{4}", 0), r"\.", "/")
    return F.coalesce(F.try_to_timestamp(day_first, F.lit("d/M/yyyy")), F.try_to_timestamp(F.regexp_extract(head, r"\d{4}-\d{2}-\d{2}", 0), F.lit("yyyy-MM-dd"))).cast("date")


def page_eli(page: Column) -> Column:
    """European Legislation Identifier that a page links to; null without one."""
    return F.nullif(F.regexp_extract(page, r"eli/[^\"'>\s]+", 0), F.lit(""))


#: Endings of names and the formats that they stand for (fixed values).
ENDINGS = {"pdf": "pdf", "html": "html", "htm": "html", "md": "markdown", "docx": "docx", "txt": "text"}


def file_format(url: Column, content: Column) -> Column:
    """Format of a document: by the ending of its url, else by its first bytes, else html by its first 1000 characters, else text."""
    ending = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"\.([A-Za-z]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in ENDINGS.items() for x in pair))
    start = F.lower(F.substring(F.try_validate_utf8(content.cast("string")), 1, 1000))
    marks = lambda text: F.coalesce(start.contains(text), F.lit(False))
    signed = lambda text: F.coalesce(F.substring(content.cast("binary"), 1, len(text)) == F.lit(text.encode()), F.lit(False))
    return F.coalesce(
        F.element_at(known, ending),
        F.when(signed("%PDF"), "pdf").when(signed("PK"), "docx").when(marks("<html") | marks("<!doctype html"), "html").otherwise("text"),
    )
