"""A worker keeps one large object at most, and training holds each word once."""

from __future__ import annotations

import tracemalloc

import numpy as np
import public_tokenizers

from regatta.llm import packing, toxicity, worker


def test_one_object_a_worker():
    path = public_tokenizers.path("byte_bpe_50k.json")
    weights = np.zeros(toxicity.BUCKETS, np.float32).tobytes()
    encoder = packing._encoder(path)
    assert packing._encoder(path) is encoder and len(worker._kept) == 1
    scorer = toxicity._scorer(weights, 0.5)
    assert toxicity._scorer(weights, 0.5) is scorer and list(worker._kept.values()) == [scorer]
    worker.let_go()
    assert not worker._kept and packing._encoder(path) is not encoder
    worker.let_go()


def test_training_holds_each_word_once():
    rng = np.random.default_rng(1)
    words = np.array([f"word{i}" for i in range(2000)])
    texts = [" ".join(rng.choice(words, 128)) + (" odd" * 20 if i % 2 else "") for i in range(1500)]
    toxic = np.arange(1500) % 2
    tracemalloc.start()
    model = toxicity.fit(texts, np.arange(1500), toxic, epochs=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.weights.any() and peak < 30_000_000
