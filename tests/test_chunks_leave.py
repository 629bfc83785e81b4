"""Chunks leave a task in small batches, whatever a batch of texts holds."""

from __future__ import annotations

import pytest

from regatta.operators import chunking


@pytest.mark.parametrize("strategy", ["recursive", "semantic", "sentence", "fixed"])
def test_chunks_in_small_batches(spark, monkeypatch, strategy):
    text = "Some words stand here. More follow!\n\n" * 60
    texts = [text, None, "", "  ", text[:50], text]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    limits = chunking.Limits(200, 20)
    expected = [(i, n, c.content, c.start, c.end) for i, t in enumerate(texts) if t for n, c in enumerate(chunking.cut(t, strategy, limits))]
    monkeypatch.setattr(chunking, "ROWS", 3)
    found = [(r.doc_id, r["index"], r.content, r.start_char, r.end_char) for r in chunking.chunks(docs, strategy, limits).collect()]
    assert found == expected and len(found) > 20
