"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.llm.labelled import CUT, WORD, Adam, Bags, fitted, held_out, in_pieces, sample_windows
from regatta.llm.worker import kept

#: Hash buckets of subwords; a word is one subword, and so are its character n-grams with word ends.
BUCKETS, GRAMS = 1 << 17, (3, 4, 5)
#: Words averaged together; the score of a text is that of its most toxic window.
WINDOW = 128
#: Shorter windows are averaged as if they had so many words, so that one odd word does not decide.
LEAST = 24
#: Factor on averages before the softmax.
GAIN = 64
REMEMBERED = 100_000


def subwords(word: str) -> list[int]:
    """Buckets of a lower-case word and its character n-grams; a piece of a long word has n-grams only."""
    marked = f"<{word}>"
    if CUT in word:
        marked = marked.removeprefix(f"<{CUT}").removesuffix(f"{CUT}>")
    n = len(marked)
    found = [] if CUT in word else [zlib.crc32(marked.encode()) % BUCKETS]
    for size in GRAMS:
        found += [zlib.crc32(marked[i : i + size].encode()) % BUCKETS for i in range(n - size + 1)]
    return found


@dataclass(frozen=True)
class Model:
    """The trained model for scoring: what each subword adds to the difference of the two logits, and the bias."""

    weights: np.ndarray
    bias: float


class _Batch:
    """Some windows, the words in them and the words' frequent subwords, as sparse averages."""

    def __init__(self, at: np.ndarray, texts: list[np.ndarray], parts: list[np.ndarray], column: np.ndarray):
        self.at = at
        ids: dict[int, int] = {}
        cells = [(r, ids.setdefault(w, len(ids))) for r, i in enumerate(at) for w in texts[i].tolist()]
        rows, words = np.array(cells, np.int64).reshape(-1, 2).T
        share = 1.0 / np.maximum(np.bincount(rows, minlength=len(at)), LEAST)
        self.windows = Bags(rows, words, share[rows], (len(at), len(ids)))
        sizes = np.array([len(parts[w]) for w in ids], np.int64)
        word = np.repeat(np.arange(len(ids)), sizes)
        found = column[np.concatenate([parts[w] for w in ids])] if len(ids) else np.zeros(0, np.int64)
        often = found >= 0
        self.columns, sub = np.unique(found[often], return_inverse=True)
        self.words = Bags(word[often], sub, (1.0 / sizes)[word[often]], (len(ids), len(self.columns)))


def _telling(spread: np.ndarray, docs: np.ndarray, least_z: float) -> np.ndarray:
    """Buckets whose shares of clean and toxic documents differ by ``least_z`` standard errors or more."""
    both = spread.sum(0) / docs.sum()
    error = np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / docs).sum())
    return np.abs(spread[1] / docs[1] - spread[0] / docs[0]) >= least_z * error


def fit(
    words: list[str], documents: np.ndarray, toxic: np.ndarray, dim: int = 4, epochs: int = 10, batch: int = 256, least_z: float = 5.0,
    decay: float = 0.001, rate: float = 0.05, seed: int = 1,
) -> Model:
    """Train embeddings and softmax jointly on windows (space-joined words) of labelled documents.

    In the first half of the epochs every window has its document's label;
    then windows of toxic documents that look clean are left out (but each
    document's most toxic one), since only some parts of a toxic text are.
    Subwords that toxic and clean documents hold about equally often could only
    be learnt by heart; they keep the weight 0 (see ``_telling``).
    """
    rng = np.random.default_rng(seed)
    if not len(words) or toxic.min() == toxic.max():
        rate = (float(toxic.sum()) + 0.5) / (len(words) + 1) if len(words) else 0.05
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(rate / (1 - rate))))
    known: dict[str, int] = {}  # each word is held once, texts are its numbers
    texts = [np.array([known.setdefault(w, len(known)) for w in text.split()], np.int32) for text in words]
    of_doc: dict[int, set[int]] = {}
    for doc, text in zip(documents.tolist(), texts, strict=True):
        of_doc.setdefault(doc, set()).update(text.tolist())
    parts = [np.array(subwords(w), np.int32) for w in known]
    kind = dict(zip(documents.tolist(), toxic.tolist(), strict=True))
    spread = np.zeros((2, BUCKETS))
    for doc, own in of_doc.items():
        if own:
            spread[kind[doc], np.unique(np.concatenate([parts[w] for w in own]))] += 1
    of_doc.clear()
    kept = np.flatnonzero(_telling(spread, np.bincount(list(kind.values()), minlength=2), least_z))
    column = np.full(BUCKETS, -1)
    column[kept] = np.arange(len(kept))
    order = rng.permutation(len(words))
    batches = [_Batch(order[i : i + batch], texts, parts, column) for i in range(0, len(order), batch)]

    embedding = rng.normal(0, 0.01, (len(kept), dim)).astype(np.float32)
    softmax = rng.normal(0, 1, (dim, 2)).astype(np.float32)
    bias = np.log(np.array([1 - toxic.mean(), toxic.mean()], np.float32))
    gain = np.float32(GAIN)  # undoes the dilution by averaging, so that steps of usual size are enough
    first, second = np.zeros_like(embedding), np.zeros_like(embedding)
    dense = Adam([softmax, bias], rate)
    target = np.stack([1 - toxic, toxic], 1).astype(np.float32)
    used, toxicity_now = np.ones(len(words), np.float32), np.zeros(len(words))
    for epoch in range(epochs):
        if epoch == epochs // 2:
            best = np.full(int(documents.max()) + 1, -1.0)
            np.maximum.at(best, documents, toxicity_now)
            used = ((toxic == 0) | (toxicity_now >= 0.5) | (toxicity_now == best[documents])).astype(np.float32)
        for k in rng.permutation(len(batches)):
            b = batches[k]
            here = embedding[b.columns]
            hidden = b.windows.dot(b.words.dot(here)) * gain
            logits = hidden @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            toxicity_now[b.at] = p[:, 1]
            error = (p - target[b.at]) * used[b.at, None] / len(b.at)
            pull = b.words.dot_t(b.windows.dot_t(error @ softmax.T * gain))
            dense.step([hidden.T @ error, error.sum(0)])
            first[b.columns] += 0.1 * (pull - first[b.columns])
            second[b.columns] += 0.01 * (pull * pull - second[b.columns])
            scale = np.float32(rate * np.sqrt(1 - 0.99**dense.t) / (1 - 0.9**dense.t))
            step = scale * first[b.columns] / (np.sqrt(second[b.columns]) + 1e-8)
            embedding[b.columns] = here * np.float32(1 - decay) - step
    weights = np.zeros(BUCKETS, np.float32)
    weights[kept] = gain * (embedding @ (softmax[:, 1] - softmax[:, 0]))
    return Model(weights, float(bias[1] - bias[0]))


class Scorer:
    """Scores whole texts; each distinct word's part in the logit is computed once."""

    def __init__(self, model: Model):
        self.weights, self.bias = model.weights.tolist(), model.bias
        self.known: dict[str, float] = {}

    def _word(self, word: str) -> float:
        found = subwords(word)
        value = sum(map(self.weights.__getitem__, found)) / len(found)
        self.known[word] = value
        return value

    def score(self, text: str) -> float:
        """Probability of the most toxic window; windows overlap by half, and pieces of long words count as words."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        words = in_pieces(WORD.findall(text.lower()))
        sums = np.zeros(len(words) + 1)
        np.cumsum([known[w] if w in known else self._word(w) for w in words], out=sums[1:])
        starts = np.arange(0, max(1, len(words) - WINDOW // 2), WINDOW // 2)
        ends = np.minimum(starts + WINDOW, len(words))
        logit = ((sums[ends] - sums[starts]) / np.maximum(ends - starts, LEAST)).max() + self.bias
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def _scorer(weights: bytes, bias: float) -> Scorer:
    return kept(("toxicity", weights, bias), lambda: Scorer(Model(np.frombuffer(weights, np.float32), bias)))


def trained(docs: DataFrame, labels: DataFrame, toxic_docs: int = 1200, clean_docs: int = 2800, windows: int = 3) -> Model:
    """Fit on at most ``toxic_docs`` and ``clean_docs`` labelled documents that are not held out.

    Of each document ``windows`` windows are read at most, chosen by a seed.
    The sample may hold a larger share of toxic documents than the labels do;
    the bias is corrected to the labels' share.  One task learns from the sample.
    """
    sample = sample_windows(docs, labels, F.col("toxic").cast("int"), WORD, True, {1: toxic_docs, 0: clean_docs}, WINDOW, most=windows)

    def learn(windows: pd.DataFrame) -> tuple[Model, float]:
        documents = windows["doc_id"].rank(method="dense").fillna(0).to_numpy().astype(np.int64)
        model = fit(windows["words"].tolist(), documents, windows["label"].to_numpy().astype(np.int64))
        return model, float(windows.drop_duplicates("doc_id")["label"].mean()) if len(windows) else 0.0

    model, sampled = fitted(sample, learn)
    rated = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    share = rated.agg(F.avg("toxic")).first()[0]
    if share and 0 < share < 1 and 0 < sampled < 1:
        logit = lambda x: float(np.log(x / (1 - x)))
        return Model(model.weights, model.bias + logit(share) - logit(sampled))
    return model


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """All columns of the documents with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Scores depend on the text alone: equal texts score alike.  Null, empty and
    wordless texts score the bias; texts of any length are scored whole; null
    and repeated ids and extra columns pass through (but those that have the
    names of the two new columns, which are replaced); an empty table gives an
    empty result.  The model sent to the tasks has a fixed size (half a MB).
    """
    weights, bias = model.weights.astype(np.float32).tobytes(), model.bias
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _scorer(shared.value, bias)
        for texts in batches:
            yield pd.Series([scorer.score(t or "") for t in texts], dtype="float64")

    scored = docs.withColumn(score_col, score(F.col("text")))
    return scored.withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Train on the labels and score every document: doc_id, held_out, score, predicted."""
    done = toxicity(docs.select("doc_id", "text"), trained(docs, labels), threshold)
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

