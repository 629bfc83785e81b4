"""Classifiers, host rules, vectors, pages and the pipeline."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from regatta.llm import host_rules, html_extract, labelled, quality_model, toxicity, vector_dedup
from regatta.llm.html_blocks import blocks
from regatta.llm.html_pages import labelled_pages
from regatta.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import same_rows


def test_all_numbered_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def labelled_docs(n=400):
    rng = random.Random(3)
    clean = ["".join(rng.choices(["an", "er", "to", "li", "sen", "mo"], k=3)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(clean, k=rng.randrange(30, 200))
        bad = i % 4 == 0
        if bad:
            for _ in range(1 + len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(["vulgarity", "slurword", "hatefuls"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(i % 5 != 0), int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows_and_misspellings(spark):
    rows, labels = labelled_docs()
    rows += [(1000, "words and words with a slurwords in it " * 3, "x"), (1001, None, "x"), (1002, "", "x"), (None, "fine", "x"), (3, rows[3][1], "x")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, source string, score double")
    rated = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, rated).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sorted(i for i, r in got.items() if i is not None and i < 1000 and r.held_out) == held
    assert sum(got[i].predicted == labels[i][2] for i in held) >= 0.97 * len(held)
    assert got[1000].predicted == 1 and got[1001].score == got[1002].score and 0 <= got[1001].score <= 1
    assert toxicity.toxicity_scores(docs.limit(0), rated.limit(0)).count() == 0


def test_quality_grades(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices(["an", "er", "to", "li", "sen"], k=3))
    rows = [(i, " ".join(word() + ("###" if i % 3 == 0 else "") for _ in range(80))) for i in range(300)]
    labels = [(i, int(i % 3 != 0), int(i % 7 == 0)) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality_model.quality(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert sum(got[i].kept == (i % 3 != 0) for i in held) >= 0.98 * len(held)
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail <= 1 for r in got.values()) and got[900].tail == got[901].tail


def test_slopes_of_the_likelihood_are_those_of_small_steps():
    rng = np.random.default_rng(3)
    signal, cut, grades = rng.normal(size=30), np.array([-0.7, 0.1, 1.3]), rng.integers(0, 4, 30)
    at, d_signal, d_cut = quality_model.slopes(signal, cut, grades)
    likelihood = lambda s, c: -np.mean([np.log(np.diff(1 - np.r_[1, 1 / (1 + np.exp(c - x)), 0])[g]) for x, g in zip(s, grades)])
    assert abs(at - likelihood(signal, cut)) < 1e-9
    for values, slope, f in ((signal, d_signal, lambda v: likelihood(v, cut)), (cut, d_cut, lambda v: likelihood(signal, v))):
        for i in range(len(values)):
            step = np.zeros(len(values))
            step[i] = 1e-5
            assert abs((f(values + step) - f(values - step)) / 2e-5 - slope[i]) < 1e-6


def test_scores_replace_columns_of_their_names_and_keep_others(spark):
    docs = spark.createDataFrame([(1, "a b", 0.1, True, "q"), (None, None, None, None, None)], "doc_id bigint, text string, Tail double, kept boolean, _q string")
    model = quality_model.Model(np.zeros(quality_model.BUCKETS, np.float32), np.array([0.0, 1.0]))
    got = quality_model.quality_scores(docs, model)
    assert got.columns == ["doc_id", "text", "_q", "expected_grade", "tail", "kept"] and got.count() == 2
    assert quality_model.quality_scores(docs.limit(0), model).count() == 0
    toxic = toxicity.toxicity(docs.withColumn("score", F.lit("x")), toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0))
    assert dict(toxic.dtypes)["score"] == "double" and {r.score for r in toxic.collect()} == {0.5}


def test_thresholds_are_ordered():
    model = quality_model.fit(["a b", "b c", "c d", "d e"] * 5, np.array([0, 1, 2, 3] * 5), 4)
    assert (np.diff(model.thresholds) > 0).all()


def test_windows_of_a_text():
    words = [str(i) for i in range(1000)]
    some = labelled.windows_of(words, 64, 5, 1)
    assert len(some) == 5 and some == labelled.windows_of(words, 64, 5, 1) and labelled.windows_of([], 64, 5, 1) == [[]]


def test_host_rules_match_the_oracle(spark, duck, small):
    same_rows(QUERIES["op6_host_rules"](spark, small), duck.sql(ORACLE_SQL["op6_host_rules"]))


def test_host_rules_with_clashing_hashes(spark, duck, small, monkeypatch):
    monkeypatch.setattr(host_rules, "PLACE_BITS", 58)
    same_rows(QUERIES["op6_host_rules"](spark, small), duck.sql(ORACLE_SQL["op6_host_rules"]))


def test_host_rules_of_odd_rows(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, None), (2, None, "h"), (3, "", "h"), (None, good, "h"), (5, "a b c " * 30, "h"), (1, good, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, n_words int")
    got = host_rules.host_rules(docs).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    assert of[2].n_words == 0 and of[2].base_failed and not of[2].kept and of[5].n_repeat_words == 90 and of[1].kept
    assert host_rules.host_rules(docs.limit(0)).count() == 0


def test_vector_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "HOME", 20)
    monkeypatch.setattr(vector_dedup, "COPY_COST", 1e-8)
    monkeypatch.setattr(vector_dedup, "GUESTS", 50)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(25, 16))
    m = np.concatenate([c + 0.13 * rng.normal(size=(int(k), 16)) for c, k in zip(centres, rng.integers(1, 12, 25))] + [rng.normal(size=(60, 16))])
    m = np.concatenate([m, m[:5], 2 * m[5:8]]).astype(np.float32)
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(m)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None]), (904, [math.nan] * 16), (905, [math.inf] * 16), (None, [1.0] * 16)]
    frame = spark.createDataFrame([*rows, *((i, v, "x") for i, v in odd)], "vec_id bigint, embedding array<float>, node string")
    got = {r.vec_id: r for r in vector_dedup.vector_links(frame, 0.95).collect()}
    d = m.astype(float)
    near = (d @ d.T) / np.outer(np.linalg.norm(d, axis=1), np.linalg.norm(d, axis=1)) >= 0.95
    label = np.arange(len(m))
    while ((new := np.array([label[row].min() for row in near])) != label).any():
        label = new
    assert near.sum() > len(m) + 50
    for i in range(len(m)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (int(near[i].sum()) - int(near[i, i]), label[i], label[i] == i)
    for i, _ in odd[:-1]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert vector_dedup.vector_links(frame.limit(0)).count() == 0


def test_rows_that_repeat_an_id_are_told_apart_by_their_vectors(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (7, [1.0, 0.01, 0.0]), (8, [0.0, 0.0, 1.0]), (8, [0.0, 0.0, 1.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.vector_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    assert got == [(5, 0, 5, True), (5, 1, 5, True), (7, 1, 5, False), (8, 1, 8, True), (8, 1, 8, True)]


def test_groups_need_few_copies_and_equally_far_vectors_few_pivots():
    rng = np.random.default_rng(1)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    grouped = unit(np.repeat(unit(rng.normal(size=(64, 64))), 60, axis=0) + 0.03 * rng.normal(size=(64 * 60, 64)))
    radius = math.sqrt(0.1)
    for n in (10**6, 10**8):
        pivots = vector_dedup.fitted_pivots(grouped, n, radius)
        d, between = vector_dedup._distances(grouped, pivots), vector_dedup._distances(pivots, pivots)
        radii = np.zeros(len(pivots))
        np.maximum.at(radii, d.argmin(1), d.min(1))
        assert len(pivots) >= 32 and vector_dedup.visits(d, between, radii, radius)[1].sum() < len(grouped)
    assert len(vector_dedup.fitted_pivots(unit(rng.normal(size=(2000, 64))), 50_000, radius)) == vector_dedup.LEAST


PAGE = """<!doctype html><html><head><title>T</title><script>var a = "<p>x</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></ul></nav><!-- <p>hidden</p> -->
<div class="cookie">We use cookies. Please agree to them.</div>
<article><h1>A &amp; B</h1><p>First   paragraph of&nbsp;the story,<br>with a break.<p>Second one has a <a href="#">link</a> and 1 &lt; 2 in it.</article>
<section class="comments"><h3>Comments</h3><p>Great story, thank you for it.</p></section>
<form><label>Mail</label><input name="m"></form><footer>&copy; example.com</footer></body></html>"""


def test_page_by_hand(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", PAGE), (4, "u", "<p>unclosed <b"), (5, "u", "a < b & c")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(frame).collect()}
    expected = "A & B\nFirst paragraph of the story, with a break.\nSecond one has a link and 1 < 2 in it."
    assert got[1].text == expected == got[None].text and got[1].n_chars == len(expected)
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_pages_not_seen_in_training():
    chain, wrong, total = html_extract.default_model(), 0, 0
    for html in labelled_pages(200, seed=77):
        found, labels = html_extract.marked(html)
        wrong += sum(a != b for a, b in zip(chain.decode(found), labels))
        total += len(labels)
    assert wrong <= 0.01 * total


def test_viterbi_is_the_best_path():
    chain = html_extract.default_model()
    page = blocks(PAGE)[:9]

    def score(labels):
        out = chain.first[labels[0]]
        for i, (b, y) in enumerate(zip(page, labels)):
            out += chain._part(html_extract._ancestor_features(b.path))[y] + chain._part(html_extract.text_features(b))[y]
            out += chain.step[labels[i - 1], y] if i else 0
        return out

    paths = [[k >> i & 1 for i in range(len(page))] for k in range(1 << len(page))]
    assert abs(score(chain.decode(page)) - max(map(score, paths))) < 1e-9


def test_pipeline_stages_in_turn(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == columns, name
        rows = out.collect()
        now = {r.doc_id for r in rows}
        assert rows and (ids is None or now <= ids), name
        if name == "simhash_near_dedup":
            assert len(now) == len(rows)
        ids, docs = now, spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in packed} == ids and max(r.offset + r.length for r in packed) <= 2048


def test_pipeline_stages_take_odd_rows_and_keep_extra_columns(spark, small):
    base = spark.read.parquet(f"{small}/documents.parquet").schema
    extra = ["size", "score", "predicted", "dedup", "_hash", "_turn", "_copies", "_id", "copies"]
    schema = T.StructType([*base.fields, *(T.StructField(c, T.StringType()) for c in extra)])
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (None, None, None, None, None), (1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (1, "other words", "en", "s", 11), (2, "", None, None, 0),
        (3, long, "en", "s", len(long)), (4, "tie one two", "en", "t", 11), (5, "tie two one", "en", "t", 11),
    ]
    mine = tuple(f"extra {c}" for c in extra)
    for docs in (spark.createDataFrame([(*r, *mine) for r in rows], schema), spark.createDataFrame([], schema)):
        empty = docs.isEmpty()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            got = out.collect()
            assert bool(got) != empty, name
            if name != "best_fit_packing":
                assert out.columns == docs.columns and all(tuple(r)[len(base) :] == mine for r in got), name
            ids = sorted((r.doc_id for r in got), key=lambda i: (i is None, i))
            if name == "suffix_array_dedup" and not empty:
                assert len(got) == len(rows) and {r.text for r in got if r.doc_id == 1} == {"a b c", "other words"} and got[0].n_chars == (None if got[0].text is None else len(got[0].text))
            if name == "simhash_near_dedup" and not empty:
                assert ids.count(1) == 2 and ids.count(2) + ids.count(None) == 1 and 3 in ids
            if name == "source_mixing" and not empty:
                assert 2 not in ids and None not in ids and 3 in ids
