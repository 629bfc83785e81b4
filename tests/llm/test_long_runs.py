"""Runs of characters without spaces are read whole by both classifiers."""

from __future__ import annotations

import random

import numpy as np

from regatta.llm import labelled, quality_model, toxicity
from tests.llm.test_models_and_vectors import labelled_docs


def test_pieces_hold_every_run_of_five_characters():
    rng = random.Random(5)
    for n in (64, 65, 66, 67, 68, 69, 200, 1001):
        word = "".join(rng.choices("abcdefghij", k=n))
        units = labelled.in_pieces([word, "short"])
        bare = [u.strip(labelled.CUT) for u in units[:-1]]
        assert units[-1] == "short" and (n > 64) == (len(bare) > 1) and bare[-1] and word.endswith(bare[-1])
        assert {word[i : i + 5] for i in range(n - 4)} == {b[i : i + 5] for b in bare for i in range(len(b) - 4)}


def test_a_toxic_word_far_inside_an_unspaced_text_is_found():
    rows, labels = labelled_docs()
    toxic = np.array([t for _, _, t in labels])
    model = toxicity.fit([t for _, t, _ in rows], np.arange(len(rows)), toxic)
    scorer = toxicity.Scorer(model)
    clean = "".join(t.replace(" ", "") for (_, t, _), bad in zip(rows, toxic) if not bad)[:2000]
    bad = clean[:1000] + "vulgarity" + clean[1000:]
    assert scorer.score(clean) < 0.3 <= scorer.score(bad)
    assert scorer.score("_".join(["an"] * 400)) < 0.3 <= scorer.score("_".join(["an"] * 400 + ["slurword"]))


def test_quality_reads_tokens_behind_their_64th_character():
    weights = np.random.default_rng(1).normal(size=quality_model.BUCKETS).astype(np.float32)
    scorer = quality_model.Scorer(weights)
    assert scorer.signal("x" * 100 + "abc" * 9) != scorer.signal("x" * 100 + "###" * 9)
    long = "y1" * 50
    units = labelled.in_pieces(["a", "a", long, long, "z" * 65, "b"])
    assert [units[i] for i in quality_model.again(units)] == ["a", units[2]]
