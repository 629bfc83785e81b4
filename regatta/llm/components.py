"""Connected components by alternating large-star and small-star steps.

The graph stays distributed: every step is a minimum per vertex (combined
before its shuffle, so a vertex of very high degree costs one row per task)
and an equi-join, in which the few hubs are broadcast.  The driver sees only a
count and a checksum of the edges per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regatta.llm.storage import removed, written


#: A vertex is a hub with more edges than ``MANY`` and than one in ``HUBS`` of all, so that there are few hubs.
MANY, HUBS = 16, 1000


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Rows (u, v) with the least neighbour ``m`` of u: by a join on u, but for hubs by a broadcast of at most 2 x ``HUBS`` rows."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    bound = max(MANY, total // HUBS)
    hubs = least.where(F.col("n") > bound).select("u", F.col("m").alias("of_hub"))
    marked = edges.join(F.broadcast(hubs), "u", "left")
    at_hub = marked.where("of_hub is not null").select("u", "v", F.col("of_hub").alias("m"))
    rest = marked.where("of_hub is null").select("u", "v").join(least.where(F.col("n") <= bound).select("u", "m"), "u")
    return at_hub.union(rest.select("u", "v", "m"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Hang every larger neighbour of u on the smallest vertex among u and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    return _with_least(both, total).where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Hang u and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    hung = _with_least(down, total).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.union(down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """Component of every vertex that has an edge.

    ``edges`` has two long columns ``a`` and ``b``; self-loops, repeated and
    reversed edges and nulls are ignored.  Returns ``node`` and ``root``, the
    smallest vertex of its component; an empty input gives an empty result.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(clean, "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))")).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        total = int(mark[0])
        old, now = now, written(_small_star(_large_star(now, total), total).where("a <> b").distinct(), "edges")
        removed(old)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
