"""Vector best-fit packing of documents into fixed-length token sequences."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from regatta.llm.ranking import ranked
from regatta.llm.storage import written
from regatta.llm.worker import kept

#: A run of white space and what follows it: the vocabulary's pattern always ends a token before white space.
SEGMENT = re.compile(r"\s*\S+|\s+")
REMEMBERED = 100_000


class ByteBPE:
    """Token ids of a byte-level BPE as packed little-endian unsigned 32-bit integers.

    ``tokenizer_path`` names the vocabulary for the tokenizers library, which
    also defines the special tokens that are recognised inside texts.  The
    ranks file of the same vocabulary next to it lets new segments be encoded
    several times faster; without it the library itself encodes them.  Each
    distinct segment is encoded once per worker.
    """

    def __init__(self, tokenizer_path: str):
        self.library = Tokenizer.from_file(tokenizer_path)
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        self.special = re.compile(f"({'|'.join(map(re.escape, special))})") if special else None
        self.special_ids = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        ranks = Path(tokenizer_path).with_suffix(".tiktoken")
        self.fast = None
        if ranks.exists():
            import public_tokenizers

            lines = map(bytes.split, ranks.read_bytes().splitlines())
            table = {base64.b64decode(a): int(b) for a, b in lines}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, bytes] = {}

    def _encode(self, segment: str) -> bytes:
        ids = self.fast.encode_ordinary(segment) if self.fast else self.library.encode(segment, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            return b"".join(self.special_ids.get(p) or self._plain(p) for p in self.special.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        segments = SEGMENT.findall(text)
        for s in segments:
            if s not in known:
                known[s] = self._encode(s)
        return b"".join(map(known.__getitem__, segments))


def _encoder(tokenizer_path: str) -> ByteBPE:
    return kept(("packing", tokenizer_path), lambda: ByteBPE(tokenizer_path))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every document's ids (with ``end_id`` after them) into pieces of at most ``capacity``.

    Only longer documents are cut; all their pieces but the first have exactly
    ``capacity`` tokens.  A null text is empty and has the end id alone.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for batch in batches:
            row, number, start, length, crc = [], [], [], [], []
            for at, text in enumerate(batch.column("text")):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                edges = [0, *range(total % capacity or capacity, total + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    row.append(at)
                    number.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(ids[4 * lo : 4 * hi]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold, and how much each residual weighs in the choice of a bin."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048  # sum of squared piece lengths
    weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)
    rule: str = "norm"  # "norm": least weighted residual norm; "dot": largest weighted dot product of demand and residual


def plan(counts: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Pack ``counts[length]`` pieces of each length, longest first, into as few bins as best-fit finds.

    Bins in the same state (residual tokens, documents, attention) are one
    class with a multiplicity, so the work depends on the number of distinct
    lengths (at most the token capacity), not on the number of pieces.  Each
    step puts pieces of one length into bins of the class that scores best
    among those that fit under every constraint, or opens bins.

    Returns rows (length, first rank, end rank, first sequence, pieces per
    sequence, offset): the piece of that length and rank r goes to sequence
    first + (r - first rank) // per, at offset + ((r - first rank) % per) * length.
    """
    full = np.array([cap.tokens, cap.documents, cap.attention], np.int64)
    scale = np.array(cap.weights) / full**2
    state = np.zeros((0, 3), np.int64)  # residuals by class
    runs: list[list[tuple[int, int]]] = []  # (first sequence, number) by class
    where: dict[tuple[int, ...], int] = {}
    rows, opened = [], 0

    def fill(residual: np.ndarray, first: int, bins: int, per: int) -> None:
        nonlocal state, rank
        rows.append((length, rank, rank + bins * per, first, per, int(full[0] - residual[0])))
        rank += bins * per
        left = residual - per * need
        if (left > 0).all():
            at = where.setdefault(tuple(left.tolist()), len(runs))
            if at == len(runs):
                state = np.vstack([state, left])
                runs.append([])
            runs[at].append((first, bins))

    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], np.int64)
        if length < 1 or (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        rank = 0
        while rank < counts[length]:
            left = counts[length] - rank
            fits = np.flatnonzero((state >= need).all(1) & np.array([bool(r) for r in runs], bool)) if runs else []
            if len(fits):
                after = (state[fits] - need).astype(float)
                score = (after**2 * scale).sum(1) if cap.rule == "norm" else -(state[fits] * need * scale).sum(1)
                at = int(fits[int(score.argmin())])
                residual = state[at].copy()
                per = int((residual // need).min())
                first, bins = runs[at].pop()
                if left < per:
                    per, used = left, 1
                else:
                    used = min(bins, left // per)
                if used < bins:
                    runs[at].append((first + used, bins - used))
                fill(residual, first, used, per)
            else:
                per = min(int((full // need).min()), left)
                fill(full.copy(), opened, left // per, per)
                opened += left // per
    return rows


def packed(docs: DataFrame, tokenizer_path: str, cap: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences.

    Returns one row per piece: the id, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id`` and ``offset``; the pieces of a sequence
    follow each other without gaps from 0.  Null and empty texts are one end
    token; null ids and repeated rows are packed like others; extra columns
    are ignored; an empty table gives an empty result.

    Only the count of pieces per length (at most one row per token of the
    capacity) reaches the driver, and the plan that goes back is bounded by
    the capacity as well, so broadcasting it is safe at any input size.  Ranks
    within a length spread over buckets (see ``ranked``).
    """
    cut = written(pieces(docs, tokenizer_path, cap.tokens, id_col=id_col, text_col=text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(counts, cap)
    slots = docs.sparkSession.createDataFrame(rows, "slot_length bigint, lo bigint, hi bigint, first bigint, per bigint, at bigint")
    numbered = ranked(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"])
    here = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = numbered.join(F.broadcast(slots), here)
    turn = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(turn / F.col("per"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + turn % F.col("per") * F.col("length")).alias("offset"),
    )
