"""Token counts, packing, mixing, SimHash and suffix dedup against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from regatta.llm import mixing, packing, ranking, simhash, suffix_dedup, token_counts
from regatta.llm.suffix_array import permuted_lcp, suffix_array

MODEL, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "a\n\n b\n", "▁x ▁", "\t\ta\r\nb", "<s>x</s>", "naïve ﬁ 😀😀", "<|endoftext|>a <|endoftext|>", "x" * 3000, "\x00a", " "]
DOCS = "doc_id bigint, text string, source string, fp string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "zz"]
    made = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60))), rng.choice(["s1", "s2", "s3", None])) for i in range(60)]
    made += [(100 + i, t, "odd") for i, t in enumerate(ODD)]
    return [*made, (7, made[7][1], made[7][2]), (None, "no id here", "s1"), (200, None, None), (201, made[3][1], "s2"), (202, made[3][1], "s2")]


def test_token_counts_equal_the_library(spark, rows):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts.token_counts(table(spark, rows), MODEL, limit=20).collect()
    expected = sorted((i is None, i or 0, len((t or "").encode()), len(model.encode(t or ""))) for i, t, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 20) for r in got)
    assert token_counts.token_counts(table(spark, []), MODEL).count() == 0


def test_packing_is_whole_and_gapless(spark, rows):
    cap = packing.Capacity(tokens=64, documents=64, attention=64 * 64)
    got = packing.packed(table(spark, rows), BPE, cap).collect()
    library = Tokenizer.from_file(BPE)
    expected = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 64 or 64
        edges = [0, *range(first, len(ids) + 1, 64)]
        expected += [(i is None, i or 0, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(e[4] for e in expected)
    assert len(bins) <= -(-total // 64) * 1.15 + 1
    assert packing.packed(table(spark, []), BPE, cap).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_holds_every_capacity(rule):
    rng = np.random.default_rng(3)
    counts = {int(k): int(v) for k, v in zip(range(1, 65), rng.integers(0, 40, 64)) if v}
    cap = packing.Capacity(tokens=64, documents=5, attention=2500, rule=rule)
    counts = {k: v for k, v in counts.items() if k * k <= 2500}
    bins: dict[int, list] = {}
    placed = dict.fromkeys(counts, 0)
    for length, lo, hi, first, per, at in packing.plan(counts, cap):
        assert lo == placed[length]
        placed[length] = hi
        for r in range(lo, hi):
            bins.setdefault(first + (r - lo) // per, []).append((at + (r - lo) % per * length, length))
    assert placed == counts
    for parts in bins.values():
        assert sum(p[1] for p in parts) <= 64 and len(parts) <= 5 and sum(p[1] ** 2 for p in parts) <= 2500
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(parts), sorted(parts)[1:]))


def test_ranks_are_exact_in_every_group(spark):
    frame = spark.createDataFrame([(i, i % 3 if i % 3 else None) for i in range(500)] + [(7, 1)], "doc_id bigint, g int")
    got = ranking.ranked(frame, ["g"], ["doc_id"], buckets=8).collect()
    for g in (None, 1, 2):
        own = sorted(r["rank"] for r in got if r.g == g)
        assert own == list(range(len(own))) and own


def test_fit_reaches_the_budget():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = np.unique(rng.integers(1, 400, 12))
        counts = rng.integers(1, 30, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        take = mixing.fit(lengths, counts, budget, window=2000)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int((take * lengths).sum()) - budget) <= lengths.min() // 2 + 1


def test_small_fits_are_the_best_there_are():
    rng = np.random.default_rng(2)
    for _ in range(100):
        lengths = np.unique(rng.integers(3, 40, 4))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum()))
        sums = {0}
        for size, n in zip(lengths, counts):
            sums = {s + k * int(size) for s in sums for k in range(n + 1)}
        more = mixing._knapsack(lengths, counts, budget)
        assert abs(int((more * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_mixing_meets_targets_and_limits(spark, rows):
    got = mixing.mixed(table(spark, rows), keep_source=True).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    held: set = set()
    while True:
        free = [s for s in order if s not in held]
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in held)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        held |= over
    for s in order:
        own = [r for r in got if r.source == s]
        target = 3 * sizes[s] if s in held else level * weight[s]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == sizes[s] for r in own)
        sums = {0}
        for r in own:
            sums |= {x + r["size"] for x in sums}
        base = int(target // sizes[s]) * sizes[s] if sizes[s] else 0
        best = min(abs(base + x - round(target)) for x in sums)
        assert abs(sum(r.taken for r in own) - round(target)) == best
    assert all(r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] for r in got)
    again = mixing.mixed(table(spark, list(reversed(rows)))).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mixed(table(spark, [])).count() == 0


def test_fingerprints_bit_by_bit():
    rng = random.Random(8)
    texts = ["", " \t", "One", "one TWO", "É é É", "a\x85b\u00a0c d e"] + [" ".join(rng.choices(["aa", "B", "c\u0130", "É", "dd"], k=rng.randrange(1, 60))) for _ in range(60)]
    for text in texts:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text.encode()) == expected


def test_close_pairs_are_all_found():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64))
    fps = np.unique(np.r_[base, near, near ^ np.uint64(4)])
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    found = {(int(a), int(b)) for i, j in simhash.close_pairs(fps, 2) for a, b in zip(i, j)}
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(apart <= 2)) if a < b}


@pytest.mark.parametrize("group", [50_000, 2])
def test_simhash_components(spark, group):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = np.unique(np.r_[base, base ^ np.uint64(1), base ^ np.uint64(7), base ^ np.uint64(1 << 40), base[:5] ^ np.uint64(0x80001)])
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    roots = {r.node: r.root for r in simhash.components(simhash.linked(frame, 2, group)).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.arange(len(fps))
    while ((new := np.array([label[row].min() for row in near])) != label).any():
        label = new
    groups: dict = {}
    for f, own in zip(fps.view(np.int64).tolist(), label):
        groups.setdefault(own, set()).add(f)
    found: dict = {}
    for f in fps.view(np.int64).tolist():
        found.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_simhash_of_odd_rows(spark, rows):
    got = simhash.simhash_groups(table(spark, rows)).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    assert of[200].fingerprint == "0" * 16 == of[100].fingerprint and of[200].component_id == 100
    assert of[201].component_id == of[202].component_id == of[3].component_id
    assert simhash.simhash_groups(table(spark, [])).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    for _ in range(300):
        n, k = rng.randrange(0, 50), rng.choice([1, 2, 3, 200])
        s = [rng.randrange(k) for _ in range(n)]
        s = (s[: max(1, n // 4)] * 5)[:n] if rng.random() < 0.3 else s
        order = suffix_array(np.array(s, dtype=np.int64))
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        lcp = permuted_lcp(np.array(s, dtype=np.int64), order, 7)
        for a, b in zip(order[1:], order[:-1]):
            k = 0
            while k < 7 and max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert lcp[a] == k


def brute_dedup(rows, length=100):
    seen, out = set(), {}
    order = sorted({(i if i is not None else 1 << 63, t or "") for i, t, _ in rows}, key=lambda x: x[0])
    for i, text in order:
        data = text.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i, text] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("limits", [{}, {"GROUP": 2, "PIECE": 700, "MANY": 2}, {"GROUP": 1, "SHARD": 400}])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("abcdefgh é\n", k=n))
    shared, other = text(180), text(105)
    rows = [(i, text(rng.randrange(0, 300)) + (shared if i % 3 == 0 else "") + text(rng.randrange(0, 200)) + (other if i % 4 == 0 else ""), None) for i in range(40)]
    rows += [(50, "ab" * 900, None), (51, "a" * 2500, None), (52, shared[:99], None), (53, rows[5][1], None), (54, None, None), (55, "", None)]
    rows += [(70 + i, f"{shared[:60]}{i}{shared[60:]}"[: 120 + i % 7], None) for i in range(12)]
    rows += [rows[9], (None, rows[6][1] + "end", None), (60, text(1500) + shared + text(1500), None)]
    got = suffix_dedup.suffix_dedup(table(spark, rows)).select("doc_id", "text", "dedup.*").collect()
    expected = brute_dedup(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id if r.doc_id is not None else 1 << 63, r.text or ""]
    assert suffix_dedup.suffix_dedup(table(spark, [])).count() == 0
