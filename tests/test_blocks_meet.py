"""Blocks of queries and of vectors meet, however many tasks the groups are dealt to."""

from __future__ import annotations

import numpy as np

from regatta.operators import documents as dc


def test_nearest_over_many_blocks_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(dc, "WORTH", 10)
    v = np.random.default_rng(3).normal(size=(200, 6))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id bigint, embedding array<double>").repartition(3)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    expected = set()
    for i in range(0, 200, 50):
        score = unit @ unit[i]
        best = [j for j in np.lexsort((np.arange(200), -score)) if j != i and score[j] >= 0.3][:5]
        expected |= {(i, int(j), n + 1) for n, j in enumerate(best)}
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        found = dc.similar(rows, rows.where("vec_id % 50 = 0"), top_k=5, threshold=0.3, block=40).select("query_id", "vec_id", "rank").collect()
    finally:
        spark.conf.unset(key)
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected
