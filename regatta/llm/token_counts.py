"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A segment is a run of spaces, or one newline, with what follows up to the next of either.
SEGMENT = re.compile("[ ▁]+[^ ▁\n]*|\n[^ ▁\n]*")
#: Bytes of text handed to one encoder call; no call holds more than this and one segment.
BATCH_BYTES = 1 << 20
#: Segments whose counts a worker remembers before it starts afresh.
REMEMBERED = 300_000


@cache
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, after a check that its vocabulary allows cuts before spaces and newlines."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    if any("\n" in p or re.search("[^▁]▁", p) for p in pieces):
        raise ValueError(f"{path}: a piece crosses a word boundary, so texts have no safe places to cut")
    if model.encode("  a\n", out_type=str)[-2:] != ["▁a", "<0x0A>"]:
        raise ValueError(f"{path}: the model rewrites white space, so texts have no safe places to cut")
    return model


def byte_batches(segments: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Group strings into batches of about ``limit`` bytes, whatever their number."""
    batch: list[str] = []
    size = 0
    for segment in segments:
        batch.append(segment)
        size += 4 * len(segment) + 16  # four bytes a character at most
        if size >= limit:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


class SegmentCounter:
    """Counts tokens by segment.

    The encoder puts one space before a text and turns spaces into a mark that
    only ever starts a piece, and a newline is a piece of its own, so no token
    spans two segments and the count of a text is the sum over its segments.
    Each new segment is encoded once; repeated ones are looked up.
    """

    def __init__(self, path: str):
        self.model = _model(path)
        self.known: dict[str, int] = {}

    def _learn(self, segments: set[str]) -> None:
        for batch in byte_batches(sorted(segments)):
            # The encoder's own leading space stands for the segment's first one; before a newline it is a token more.
            texts = [s if s[0] == "\n" else s[1:] for s in batch]
            for s, ids in zip(batch, self.model.encode(texts, num_threads=1), strict=True):
                self.known[s] = 1 if len(s) == 1 and s != "\n" else len(ids) - (s[0] == "\n")

    def counts(self, texts: list[str]) -> list[int]:
        cut = [SEGMENT.findall(f" {t}") if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = {s for segments in cut for s in segments if s not in self.known}
        self._learn(new)
        return [sum(map(self.known.__getitem__, segments)) for segments in cut]


@cache
def _counter(path: str) -> SegmentCounter:
    return SegmentCounter(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Byte and token counts of every whole text.

    The model counts without begin, end or added special tokens; special
    strings inside a text are ordinary text, as the library's default has it.
    ``model_path`` must be readable on every executor.

    Returns one row per input row: the id, ``n_bytes`` (UTF-8), ``n_tokens``
    and ``over_limit`` (more than ``limit`` tokens).  A null text counts as
    empty: 0 bytes, 0 tokens.  Null and repeated ids pass through, extra
    columns are ignored, an empty table gives an empty result.  Memory per
    task is one Arrow batch and a bounded memory of segments, however long a
    text is.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in batches:
            text = batch.column("text")
            size = pa.compute.binary_length(text.cast(pa.large_binary())).cast(pa.int64())
            tokens: list[int] = []
            for some in byte_batches(t.as_py() for t in text):
                tokens += counter.counts(some)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
