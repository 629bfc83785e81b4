"""Chunks of documents: spans of a text that end at the best place within reach.

A strategy is a list of levels, each a kind of place where a text may be cut,
the best first.  One rule packs them all: from where a chunk starts it reaches
as far as the limit allows, to the last place of the best level that has one
within reach, and to the limit itself where no level has one.  A chunk is the
text between two cuts without the white space at its ends, so that its place
is exact (``text[start:end] == content``) and separators inside stay as they
are.  No chunk exceeds the limit, and only white space, headings' small parts
(structural strategy) and overlaps keep the chunks from adding up to the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Largest chunk, overlap of fixed chunks, and least structural chunk, in characters."""

    most: int = 4000
    overlap: int = 200
    least: int = 100

    def __post_init__(self) -> None:
        if self.most < 1 or self.overlap < 0:
            raise ValueError("a chunk has at least one character and no negative overlap")


@dataclass(frozen=True)
class Chunk:
    """A piece of a text; ``overlap`` is how much of it the piece before has too."""

    content: str
    start: int
    end: int
    section: str | None = None
    overlap: int = 0


def _behind(pattern: str, flags: int = 0) -> re.Pattern:
    """A level of places behind what the pattern matches."""
    return re.compile(pattern, flags)


# Levels: a text may be cut at the end of every match.
PARAGRAPH = _behind(r"\n\s*\n")
LINE = _behind(r"\n")
SENTENCE = _behind(r"[.!?]+\s+")
CAPITAL_SENTENCE = _behind(r"[.!?]+\s+(?=[A-Z])")
WORD = _behind(r"\s+")
#: Before a line that begins with the name of a part and a number, or with a dotted number and a capital.
HEADING = _behind(r"(?:\A|\n)(?=(?:(?i:chapter|article|section|part)\s+(\d[\d.]*)|\d+(?:\.\d+)+\s+[A-Z]))")

LEVELS = {
    "semantic": (PARAGRAPH, SENTENCE, WORD),
    "sentence": (CAPITAL_SENTENCE, SENTENCE, WORD),
    "fixed": (SENTENCE, WORD),
    "recursive": (PARAGRAPH, HEADING, LINE, SENTENCE, WORD),
}
STRATEGIES = ("structural", *LEVELS)


def packed(text: str, levels: tuple[re.Pattern, ...], most: int, overlap: int = 0) -> Iterator[tuple[int, int]]:
    """Spans from cut to cut, each as long as the limit allows; every span but the first starts ``overlap`` before the last cut."""
    places = [[m.end() for m in level.finditer(text)] for level in levels]
    at, cut = 0, 0
    while cut < len(text):
        reach = at + most
        if reach >= len(text):
            cut = len(text)
        else:
            # The best level that has a place behind the last cut and within reach.
            last = (ends[i - 1] for ends in places if (i := bisect_right(ends, reach)))
            cut = next((p for p in last if p > cut), reach)
        yield at, cut
        at = cut - min(overlap, most - 1)


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    piece = text[start:end]
    return start + len(piece) - len(piece.lstrip()), start + len(piece.rstrip())


def _pieces(text: str, spans: Iterator[tuple[int, int]], by: int = 0, overlap: int = 0) -> Iterator[Chunk]:
    """The spans that hold more than white space."""
    previous = 0
    for start, end in spans:
        a, b = _trimmed(text, start, end)
        if a < b:
            yield Chunk(text[a:b], by + a, by + b, overlap=max(0, previous - a) if overlap else 0)
            previous = b


def _sections(text: str, limits: Limits) -> Iterator[Chunk]:
    """What stands between headings: dropped below the least size, divided above the largest."""
    heads = [(m.end(), m[1] and m[1].rstrip(".")) for m in HEADING.finditer(text)]
    starts = heads if heads and heads[0][0] == 0 else [(0, None), *heads]
    for (start, number), (end, _) in zip(starts, [*starts[1:], (len(text), None)]):
        a, b = _trimmed(text, start, end)
        if b - a > limits.most:
            yield from _pieces(text[a:b], packed(text[a:b], LEVELS["recursive"], limits.most), by=a)
        elif b - a >= limits.least:
            yield Chunk(text[a:b], a, b, number)


def cut(text: str, strategy: str, limits: Limits = Limits()) -> list[Chunk]:
    """Chunks of one text in order; a blank text has none."""
    if strategy == "structural":
        return list(_sections(text, limits))
    overlap = limits.overlap if strategy == "fixed" else 0
    return list(_pieces(text, packed(text, LEVELS[strategy], limits.most, overlap), overlap=overlap))


def merged(text: str, chunks: list[Chunk], most: int) -> list[Chunk]:
    """Neighbours joined, with the text between them, while they fit; the first one's section stays."""
    out: list[Chunk] = []
    for c in chunks:
        if out and c.end - out[-1].start <= most:
            first = out[-1]
            out[-1] = Chunk(text[first.start : c.end], first.start, c.end, first.section, first.overlap)
        else:
            out.append(c)
    return out


SCHEMA = (
    "doc_id bigint, index int, total_chunks int, content string, start_char int, end_char int, section_number string, "
    "estimated_tokens int, overlap_with_previous int"
)
#: The same for Arrow.
ARROW = pa.schema([(c, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for c, t in (f.split() for f in SCHEMA.split(", "))])
#: Characters and rows of chunks that are held at most before they leave a task.
HELD, ROWS = 1 << 20, 1 << 12


def chunks(docs: DataFrame, strategy: str = "recursive", limits: Limits = Limits(), merge: bool = False) -> DataFrame:
    """One row per chunk of every document (``doc_id``, ``text``), numbered from 0; null and blank texts have none."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            # Texts are read one at a time, and chunks leave before many are held.
            for doc_id, text in zip(*batch.columns):
                doc_id, text = doc_id.as_py(), text.as_py()
                own = cut(text, strategy, limits) if text else []
                own = merged(text, own, limits.most) if merge else own
                for i, c in enumerate(own):
                    rows.append((doc_id, i, len(own), c.content, c.start, c.end, c.section, len(c.content) // 4, c.overlap))
                    size += len(c.content)
                    if size >= HELD or len(rows) >= ROWS:
                        yield table(rows)
                        rows, size = [], 0
            if rows:
                yield table(rows)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
