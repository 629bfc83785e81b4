"""Quality: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.llm.columns import fresh
from regatta.llm.labelled import CUT, Adam, Bags, fitted, held_out, in_pieces, sample_windows

TOKEN = re.compile(r"\S+")
BUCKETS = 1 << 16
WINDOW = 64
REMEMBERED = 100_000
#: Runs of digits, and of letters; a run of letters keeps no more than its case.
RUN = re.compile(r"\d+|[^\W\d_]+")


def _sign(run: re.Match) -> str:
    text = run[0]
    return "0" if text[0].isdigit() else "a" if text.islower() else "A" if text.isupper() and len(text) > 1 else "Aa"


def features(token: str) -> tuple[int, int]:
    """Buckets of a token's lower-case form and of its shape (runs of letters and digits become one sign)."""
    shape = RUN.sub(_sign, token)
    return zlib.crc32(token.lower().encode()) % BUCKETS, zlib.crc32(b"shape " + shape.encode()) % BUCKETS


#: Bucket of a token that equals the one before it.
AGAIN = zlib.crc32(b"again") % BUCKETS


def again(units: list[str]) -> list[int]:
    """Places where a token that equals the one before it starts; pieces of long tokens are taken together."""
    if not any(CUT in u for u in units):
        return [i for i in range(1, len(units)) if units[i] == units[i - 1]]
    starts = [i for i, u in enumerate(units) if not i or not u.startswith(CUT)]
    tokens = [units[a:b] for a, b in zip(starts, [*starts[1:], len(units)])]
    return [starts[i] for i in range(1, len(starts)) if tokens[i] == tokens[i - 1]]


@dataclass(frozen=True)
class Model:
    """Weight of each bucket, and the ordered thresholds between grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, signal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and probability of each grade or a higher one (columns 1, 2, ...)."""
        tail = _sigmoid(signal[:, None] - self.thresholds[None, :])
        return tail.sum(1), tail


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def slopes(signal: np.ndarray, cut: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades, and its gradients in the signals and in the thresholds."""
    n, levels = len(signal), len(cut) + 1
    at = np.arange(n)
    tail = np.c_[np.ones(n), _sigmoid(signal[:, None] - cut[None, :]), np.zeros(n)]
    p = np.maximum(tail[at, grades] - tail[at, grades + 1], 1e-9)
    slope = tail * (1 - tail)  # of each tail in the signal; 0 at both ends
    d_signal = -(slope[at, grades] - slope[at, grades + 1]) / p / n
    d_cut = np.zeros((n, levels + 1))
    d_cut[at, grades] += slope[at, grades] / p / n
    d_cut[at, grades + 1] -= slope[at, grades + 1] / p / n
    return float(-np.log(p).mean()), d_signal, d_cut[:, 1:levels].sum(0)


def fit(texts: list[str], grades: np.ndarray, levels: int, epochs: int = 120) -> Model:
    """Maximise the likelihood of grades 0 .. ``levels`` - 1 under shared weights and ordered thresholds.

    P(grade >= k) = sigmoid(x.w - t_k), and t_1 < t_2 < ... because each
    threshold is the one before it plus the exponential of a free parameter.
    """
    counts = np.bincount(grades, minlength=levels).astype(float) if len(grades) else np.ones(levels)
    above = np.clip(np.cumsum(counts[::-1])[::-1][1:] / max(1.0, counts.sum()), 1e-3, 1 - 1e-3)
    start = -np.log(above / (1 - above))
    start = np.maximum.accumulate(start + 1e-2 * np.arange(levels - 1))
    if not len(texts):
        return Model(np.zeros(BUCKETS, np.float32), start)
    rows, cols, values = [], [], []
    for r, text in enumerate(texts):
        tokens = text.split()
        repeats = set(again(tokens))
        for i, token in enumerate(tokens):
            for c in (*features(token), *([AGAIN] if i in repeats else [])):
                rows.append(r)
                cols.append(c)
                values.append(1.0 / len(tokens))
    bags = Bags(np.array(rows, np.int64), np.array(cols, np.int64), np.array(values), (len(texts), BUCKETS))
    weights = np.zeros((BUCKETS, 1), np.float32)
    first = start[:1].astype(np.float32)
    gaps = np.log(np.maximum(np.diff(start), 1e-2)).astype(np.float32)
    gain = np.float32(8.0)
    steps = Adam([weights, first, gaps], 0.1)
    for _ in range(epochs):
        signal = gain * bags.dot(weights)[:, 0]
        cut = np.cumsum(np.r_[first, np.exp(gaps)])
        _, d_signal, d_cut = slopes(signal, cut, grades)
        later = np.cumsum(d_cut[::-1])[::-1]
        pull = gain * bags.dot_t(d_signal[:, None].astype(np.float32)) + np.float32(1e-6) * weights
        steps.step([pull, later[:1].astype(np.float32), (later[1:] * np.exp(gaps)).astype(np.float32)])
    return Model(gain * weights[:, 0], np.cumsum(np.r_[first, np.exp(gaps)]).astype(float))


class Scorer:
    """Signal of whole texts; each distinct token's weight is computed once."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.tolist()
        self.known: dict[str, float] = {}

    def _token(self, token: str) -> float:
        a, b = features(token)
        self.known[token] = value = self.weights[a] + self.weights[b]
        return value

    def signal(self, text: str) -> float:
        """Mean weight of a text's tokens; pieces of long tokens count as tokens."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        tokens = TOKEN.findall(text)
        if not tokens:
            return 0.0
        repeats = sum(map(str.__eq__, tokens, tokens[1:]))
        units = in_pieces(tokens)
        total = sum([known[t] if t in known else self._token(t) for t in units])
        return (total + repeats * self.weights[AGAIN]) / len(units)


@lru_cache(maxsize=1)
def _scorer(weights: bytes) -> Scorer:
    return Scorer(np.frombuffer(weights, np.float32))


def graded(quality: Column, toxic: Column) -> Column:
    """Grade of a rated document: 0 bad, 1 sound text that is toxic, 2 sound and clean; null where unrated."""
    return F.when(quality == 0, 0).when((quality == 1) & (F.coalesce(toxic, F.lit(0)) == 1), 1).when(quality == 1, 2)


def trained(docs: DataFrame, labels: DataFrame, per_grade: int = 1500, windows: int = 8) -> Model:
    """Fit on at most ``per_grade`` documents of each grade that are not held out, ``windows`` windows of each at most."""
    grade = graded(F.col("quality"), F.col("toxic")).cast("int")
    sample = sample_windows(docs, labels, grade, TOKEN, False, {k: per_grade for k in range(3)}, WINDOW, most=windows)
    return fitted(sample, lambda windows: fit(windows["words"].tolist(), windows["label"].to_numpy().astype(np.int64), 3))


def quality_scores(docs: DataFrame, model: Model, least_grade: int = 1, least_tail: float = 0.5) -> DataFrame:
    """All columns of the documents with ``expected_grade``, ``tail`` and ``kept``.

    ``tail`` is the probability of ``least_grade`` or better; a document is
    kept from ``least_tail`` on.  Null, empty and blank texts have the signal 0,
    so that the thresholds alone grade them; texts of any length are scored
    whole; null and repeated ids and extra columns pass through (but those that
    have the names of the new columns, which are replaced); an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32).tobytes())
    fixed = Model(np.zeros(0), model.thresholds)

    @F.pandas_udf("expected_grade double, tail double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(shared.value)
        for texts in batches:
            expected, tail = fixed.grades(np.array([scorer.signal(t or "") for t in texts], float))
            yield pd.DataFrame({"expected_grade": expected, "tail": tail[:, least_grade - 1]})

    q, new = fresh("_q", docs.columns), ("expected_grade", "tail", "kept")
    scored = docs.withColumn(q, score(F.col("text")))
    tail = F.col(f"{q}.tail")
    return scored.select(*(c for c in docs.columns if c.lower() not in new), f"{q}.expected_grade", tail.alias("tail"), (tail >= least_tail).alias("kept"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels and grade every document: doc_id, held_out, expected_grade, tail, kept."""
    done = quality_scores(docs.select("doc_id", "text"), trained(docs, labels))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail", "kept")
