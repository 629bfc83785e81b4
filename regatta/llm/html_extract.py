"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.llm.html_blocks import Block, blocks
from regatta.llm.html_pages import MARK, labelled_pages
from regatta.llm.labelled import Adam, Bags

REMEMBERED = 50_000


@cache
def _ancestor_features(path: tuple[str, ...]) -> tuple[str, ...]:
    """Tags and names of the ancestors, the nearest two apart."""
    found = set()
    for depth, item in enumerate(reversed(path)):
        tag, *names = item.split(".")
        found.add(f"in {tag}")
        found.update(f"named {n}" for n in names)
        if depth < 2:
            found.add(f"near {depth} {tag}")
    return tuple(sorted(found))


def text_features(block: Block) -> tuple[str, ...]:
    """Length, share of link text and last character of a block, in coarse steps."""
    words = block.text.count(" ") + 1
    size = "1" if words == 1 else "2" if words < 4 else "4" if words < 10 else "10" if words < 25 else "25"
    share = block.linked / len(block.text)
    linked = "none" if share == 0 else "some" if share < 0.5 else "most"
    last = block.text[-1]
    end = "stop" if last in ".!?" else "letter" if last.isalnum() else "other"
    return (f"size {size}", f"link {linked}", f"end {end}", f"{size} {linked} {end}", *(["rights"] if "©" in block.text else []))


class Chain:
    """Weights of a two-label chain: per feature and label, and per pair of neighbouring labels."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, step: np.ndarray, first: np.ndarray):
        self.index, self.emit, self.step, self.first = index, emit, step, first
        self.known: dict[tuple[str, ...], tuple[float, float]] = {}

    def _part(self, features: tuple[str, ...]) -> tuple[float, float]:
        found = self.known.get(features)
        if found is None:
            at = [self.index[f] for f in features if f in self.index]
            total = self.emit[at].sum(0) if at else np.zeros(2)
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = self.known[features] = (float(total[0]), float(total[1]))
        return found

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi: the most probable labels of a page's blocks together."""
        if not page:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        best0, best1 = self.first.tolist()
        back: list[tuple[int, int]] = []
        for i, block in enumerate(page):
            a, b = self._part(_ancestor_features(block.path)), self._part(text_features(block))
            if i:
                from0 = (best0 + s00, best1 + s10)
                from1 = (best0 + s01, best1 + s11)
                back.append((int(from0[1] > from0[0]), int(from1[1] > from1[0])))
                best0, best1 = max(from0), max(from1)
            best0 += a[0] + b[0]
            best1 += a[1] + b[1]
        labels = [int(best1 > best0)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = 80, decay: float = 1e-3) -> Chain:
    """Maximise the conditional likelihood of the labels; all pages step through the chain together."""
    index: dict[str, int] = {}
    rows, cols, labels, page_of, place = [], [], [], [], []
    for p, (found, marks) in enumerate(pages):
        for i, (block, label) in enumerate(zip(found, marks, strict=True)):
            for f in (*_ancestor_features(block.path), *text_features(block)):
                rows.append(len(labels))
                cols.append(index.setdefault(f, len(index)))
            labels.append(label)
            page_of.append(p)
            place.append(i)
    y, page_of, place = np.array(labels), np.array(page_of), np.array(place)
    bags = Bags(np.array(rows), np.array(cols), np.ones(len(rows)), (len(y), len(index)))
    n, longest = len(pages), int(place.max()) + 1
    inside = np.zeros((n, longest), bool)
    inside[page_of, place] = True
    gold = np.zeros((n, longest), np.int64)
    gold[page_of, place] = y
    emit = np.zeros((len(index), 2), np.float32)
    step, first = np.zeros((2, 2), np.float32), np.zeros(2, np.float32)
    adam = Adam([emit, step, first], 0.1)
    both = inside[:, 1:] & inside[:, :-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    one_hot = np.eye(2)[y]
    for _ in range(epochs):
        scores = np.zeros((n, longest, 2))
        scores[page_of, place] = bags.dot(emit)
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = first + scores[:, 0]
        for i in range(1, longest):
            on = np.logaddexp.reduce(ahead[:, i - 1, :, None] + step, axis=1) + scores[:, i]
            ahead[:, i] = np.where(inside[:, i, None], on, ahead[:, i - 1])
        behind = np.zeros((n, longest, 2))
        for i in range(longest - 2, -1, -1):
            on = np.logaddexp.reduce(step + (scores[:, i + 1] + behind[:, i + 1])[:, None, :], axis=2)
            behind[:, i] = np.where(inside[:, i + 1, None], on, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p = np.exp(ahead + behind - total[:, None, None])
        joint = ahead[:, :-1, :, None] + step + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = np.exp(joint[both]).sum(0)
        adam.step(
            [
                bags.dot_t(((p[page_of, place] - one_hot) / n).astype(np.float32)) + np.float32(decay) * emit,
                ((expected - seen) / n + decay * step).astype(np.float32),
                ((p[:, 0] - np.eye(2)[gold[:, 0]]).sum(0) / n + decay * first).astype(np.float32),
            ]
        )
    return Chain(index, emit.astype(float), step.astype(float), first.astype(float))


def marked(html: str) -> tuple[list[Block], list[int]]:
    """Blocks of a generated page without their marks, and their labels."""
    found = blocks(html)
    labels = [int(b.text.startswith(MARK)) for b in found]
    return [b._replace(text=b.text.replace(MARK, "") or "x") for b in found], labels


@cache
def default_model() -> Chain:
    """The chain fitted to the generated labelled pages."""
    pages = [marked(html) for html in labelled_pages()]
    return fit([p for p in pages if p[0]])


def main_text(chain: Chain, html: str) -> str:
    """Main blocks of a page in page order, joined by newlines."""
    found = blocks(html)
    return "\n".join(b.text for b, label in zip(found, chain.decode(found), strict=True) if label)


def extract(pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page.

    Returns one row per input row: the id, the url, ``text`` (empty if the page
    has none) and ``n_chars`` (its code points).  A null or empty page has the
    empty text; null ids and urls and repeated rows pass through; extra columns
    are ignored; an empty table gives an empty result.  The whole page is read,
    whatever its length.  The model sent to the tasks has a row per feature of
    the training pages (a few hundred).
    """
    chain = chain or default_model()
    shared = pages.sparkSession.sparkContext.broadcast((chain.index, chain.emit, chain.step, chain.first))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Chain(*shared.value)
        for htmls in batches:
            yield pd.Series([main_text(own, h) if h else "" for h in htmls], dtype=object)

    done = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text(F.col(html_col)).alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("bigint"))
