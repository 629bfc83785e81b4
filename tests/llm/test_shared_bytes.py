"""Bytes that all strings of a snippet share are one symbol of its suffix array; names that stand once are not sorted again."""

from __future__ import annotations

import random

import numpy as np

from regatta.llm import suffix_array as sa
from regatta.llm import suffix_dedup


def test_shared_bytes_are_one_symbol(monkeypatch):
    rng, length, half = random.Random(3), 100, 34
    middles = [bytes(rng.randrange(256) for _ in range(length - half + 1)) for _ in range(3)]
    bits, start = [], []
    for _ in range(60):
        before, behind = (bytes(rng.choice(b"ab") for _ in range(rng.randrange(half))) for _ in range(2))
        before = before if rng.random() < 0.5 else (b"b" * half)[: len(before)]
        behind = (behind if rng.random() < 0.5 else b"a" * half)[: half - 1]
        if len(before) + len(behind) >= half - 1:  # a string at least
            bits.append(before + rng.choice(middles) + behind)
            start.append(len(before))
    n = len(bits)
    key, tie, low = np.arange(n), np.zeros(n, np.int64), np.array([1000 * i for i in range(n)])
    sizes = []
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text: sizes.append(len(text)) or sa.suffix_array(text))
    shares = np.full(n, length - half + 1, np.int16)
    of, place = suffix_dedup.repeated_strings(bits, key, tie, low, np.array(start, np.int16), shares, length)
    seen, expected = set(), set()
    for i, b in enumerate(bits):
        for s in range(min(start[i], len(b) - length) + 1):
            if b[s : s + length] in seen:
                expected.add((i, 1000 * i + s))
            seen.add(b[s : s + length])
    assert set(zip(of.tolist(), place.tolist())) == expected and len(expected) > 20
    assert sizes == [sum(map(len, bits)) + n - n * (length - half)]


def test_single_names_are_left_out(monkeypatch):
    rng = np.random.default_rng(1)
    once = rng.permutation(np.arange(100, 1100))
    text = np.concatenate([once[:500], [5, 3, 4, 3, 4, 3, 7], once[500:], [3, 4, 3, 4, 3, 9]])
    sorted_texts = []
    induced = sa._induced
    monkeypatch.setattr(sa, "_induced", lambda text, *rest: sorted_texts.append(len(text)) or induced(text, *rest))
    order = sa.suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert sorted_texts[0] == len(text) and max(sorted_texts[1:-1], default=0) < 20
