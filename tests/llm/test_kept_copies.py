"""The pipeline keeps exactly one row of each SimHash group, whatever ids repeat or are missing."""

from __future__ import annotations

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def text(seed: int) -> str:
    return " ".join(f"word{seed}x{i}" for i in range(60))


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def ordered(rows):
    return sorted(rows, key=repr)


def test_a_repeated_id_keeps_only_the_rows_that_stand_for_a_group(spark):
    a, b, c, d = map(text, range(4))
    # Id 5 is a copy of id 3 as text a, and the first of its own group as text b; id 7 is two unlike texts.
    rows = [(3, a), (5, a), (5, b), (9, b), (7, c), (7, d)]
    expected = ordered([(3, a), (5, b), (7, c), (7, d)])
    assert kept(spark, rows) == expected
    # Rows of other groups change nothing.
    more = [(20, text(9)), (20, text(8)), (20, text(8))]
    assert kept(spark, rows + more) == ordered([*expected, (20, text(9)), (20, text(8))])


def test_rows_without_id_are_copies_like_others(spark):
    a, b = text(0), text(1)
    assert kept(spark, [(None, a), (4, a), (None, b), (None, b)]) == ordered([(4, a), (None, b)])
