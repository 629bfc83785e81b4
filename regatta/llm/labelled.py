"""Bounded, seeded samples of labelled text windows for fitting classifiers."""

from __future__ import annotations

import multiprocessing
import pickle
import re
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.llm.worker import let_go

WORD = re.compile(r"\w+")


#: Words over this many characters are read as pieces of ``PIECE`` characters, about as long as ordinary words;
#: neighbours share ``SHARED`` characters, so that every run of five is whole in one of them.
LONGEST, PIECE, SHARED = 64, 12, 4
#: Stands at the ends of a piece that are not ends of its word.
CUT = "\ue000"


def in_pieces(words: list[str]) -> list[str]:
    """The words, the long ones as overlapping pieces; nothing of a word is left out."""
    if max(map(len, words), default=0) <= LONGEST:
        return words
    out = []
    for w in words:
        if len(w) <= LONGEST:
            out.append(w)
            continue
        last = len(w) - SHARED
        out += [f"{CUT if at else ''}{w[at : at + PIECE]}{CUT if at + PIECE < len(w) else ''}" for at in range(0, last, PIECE - SHARED)]
    return out


def held_out(id_col: Column) -> Column:
    """Rows that no classifier may learn from: crc32 of the id as text has remainder 2 modulo 4 (never for null)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def windows_of(words: list[str], width: int, most: int, seed: int) -> list[list[str]]:
    """At most ``most`` windows of ``width`` words, spread over a text by a seed."""
    starts = range(0, max(1, len(words)), width)
    if len(starts) > most:
        starts = np.sort(np.random.default_rng(seed).choice(np.array(starts), most, replace=False))
    return [words[s : s + width] for s in starts]


def sample_windows(
    docs: DataFrame, labels: DataFrame, label: Column, split: re.Pattern, lower: bool, per_class: dict[int, int], width: int = 64, most: int = 8
) -> DataFrame:
    """Windows (doc_id, label, words) of labelled documents that are not held out, at most ``per_class[label]`` documents of a label.

    Labels that repeat an id take their largest value; null ids and labels are
    left out.  Of rows that repeat an id one is read, the one with the least
    hash of its text.  Only ids of the sample are broadcast (its size is the
    bound); there are ``per_class`` x ``most`` x ``width`` words or pieces of
    long words at most.
    """
    rated = labels.select("doc_id", label.alias("label")).where("doc_id is not null and label is not null")
    rated = rated.groupBy("doc_id").agg(F.max("label").alias("label")).where(~held_out(F.col("doc_id")))
    chosen = None
    for value, bound in per_class.items():
        part = rated.where(F.col("label") == value).orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(bound)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # One row an id, chosen before the shuffle, so an id with any number of rows costs no more than another.
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    texts = texts.select("doc_id", "text", "label")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()  # what an earlier step has left in this worker
        for frame in frames:
            rows = []
            for doc_id, text, value in frame.itertuples(index=False):
                words = in_pieces(split.findall((text or "").lower() if lower else text or ""))
                seed = zlib.crc32(str(doc_id).encode())
                rows += [(doc_id, int(value), " ".join(w)) for w in windows_of(words, width, most, seed)]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "words"])

    return texts.mapInPandas(cut, "doc_id bigint, label int, words string")


def _apart(fit: Callable[[pd.DataFrame], Any], windows: pd.DataFrame) -> bytes:
    """The pickled result of ``fit``, made in a child of this process, whose memory goes back to the system when it ends."""
    context = multiprocessing.get_context("fork")
    result, told = context.Pipe(duplex=False)

    def child() -> None:
        try:
            said = True, fit(windows)
        except Exception as problem:
            said = False, repr(problem)
        told.send_bytes(pickle.dumps(said))

    process = context.Process(target=child)
    process.start()
    told.close()
    try:
        done, value = pickle.loads(result.recv_bytes())
    except EOFError:
        done, value = False, "the process that learns has ended"
    process.join()
    if not done:
        raise RuntimeError(value)
    return pickle.dumps(value)


def fitted(sample: DataFrame, fit: Callable[[pd.DataFrame], Any]) -> Any:
    """What ``fit`` makes of a bounded sample of windows, in one task, so that the driver holds no training data.

    The windows are handed over without repeats and in one order, whatever
    their partitions.  The task learns in a process of its own, as workers
    are used again and would keep the memory.  A task that is lost is run
    again and gives the same.
    """

    def whole(frames: list[pd.DataFrame]) -> pd.DataFrame:
        found = pd.concat(frames) if frames else pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "label": pd.Series(dtype="int32"), "words": pd.Series(dtype="object")})
        return found.drop_duplicates().sort_values(["doc_id", "words"], ignore_index=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        yield pd.DataFrame({"model": [_apart(fit, whole(list(frames)))]})
        let_go()

    row = sample.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(row["model"]) if row else fit(whole([]))


class Bags:
    """Rows of weighted columns as a sparse matrix, with products in both directions."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        narrow = lambda x: x.astype(np.int32)
        self.by_row, self.by_col = narrow(np.argsort(rows, kind="stable")), narrow(np.argsort(cols, kind="stable"))
        self.rows, self.cols, self.values = narrow(rows), narrow(cols), values.astype(np.float32)

    def _sum(self, order: np.ndarray, key: np.ndarray, other: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, dense.shape[1]), np.float32)
        if len(order):
            k = key[order]
            heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            out[k[heads]] = np.add.reduceat(dense[other[order]] * self.values[order, None], heads, axis=0)
        return out

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return self._sum(self.by_row, self.rows, self.cols, dense, self.shape[0])

    def dot_t(self, dense: np.ndarray) -> np.ndarray:
        return self._sum(self.by_col, self.cols, self.rows, dense, self.shape[1])


class Adam:
    """Adam steps for a list of arrays, in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m = [np.zeros_like(a) for a in arrays]
        self.v = [np.zeros_like(a) for a in arrays]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)
