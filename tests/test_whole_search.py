"""The similarity search with more queries than one block holds."""

from __future__ import annotations

import numpy as np

from regatta.operators import documents as dc
from regatta.plans.catalog import QUERIES
from regatta.sources.domain import table


def test_blocks_of_queries_equal_brute_force(spark):
    m = np.random.default_rng(3).normal(size=(240, 6)).astype(np.float32)
    m[200:220] = m[0]
    rows = [*((i, v.tolist()) for i, v in enumerate(m)), (900, None), (901, []), (902, [0.0] * 6), (903, [1.0, None]), (904, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    got = {}
    for r in dc.similar(frame, frame.where("vec_id % 2 = 0"), 4, 0.3, block=25).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    d = m.astype(float)
    d /= np.linalg.norm(d, axis=1)[:, None]
    score = np.round(d @ d.T, 12)
    for q in range(0, 240, 2):
        best = sorted((-score[q, i], i) for i in range(240) if i != q and score[q, i] >= 0.3)[:4]
        assert got.pop(q, []) == [(k + 1, i) for k, (_, i) in enumerate(best)]
    assert not got


def test_queries_grow_with_the_table(spark, small):
    vectors = table(spark, small, "embeddings")
    asked = {r.vec_id for r in vectors.where("vec_id % 50 = 0").select("vec_id").collect()}
    found = {r.query_id for r in QUERIES["n22_similar_whole"](spark, small).collect()}
    assert found <= asked and max(found) >= 20
