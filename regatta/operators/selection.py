"""Exact percentiles of keys of any size, by narrowing where a rank lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regatta.operators.storage import checkpointed, discarded

#: Different values that one task may rank, and parts into which a round divides those that are left.
RANKED, PARTS = 1_000_000, 64


def percentiles(rows: DataFrame, key: str, value: str, points: tuple[int, ...]) -> DataFrame:
    """Nearest-rank percentiles of each key (the value at place floor(n p / 100), from 0), with count and extremes.

    Returns ``key``, ``p``, ``percentile``, ``n``, ``least`` and ``most``;
    null values do not count.  Rows are reduced to counts of different values.
    Keys with at most ``RANKED`` of them are ranked by a window; of the others
    a round divides the values that may hold a rank into about equal parts,
    sums the counts of each part and goes on with the part that holds it,
    until few enough are left for a window.  The parts come from approximate
    quantiles, the counts are exact, so the result is exact too.
    """
    counts = checkpointed(rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count("*").alias("c")))
    totals = checkpointed(
        counts.groupBy("key").agg(F.sum("c").alias("n"), F.count("*").alias("different"), F.min("value").alias("least"), F.max("value").alias("most"))
    )
    asked = totals.withColumn("p", F.explode(F.array(*map(F.lit, points)))).withColumn("place", F.floor(F.col("n") * F.col("p") / 100))
    # Large keys are fewer than different values / RANKED.
    large = asked.where(F.col("different") > RANKED).select("key", "p", "place", F.lit(0).cast("bigint").alias("below"), F.col("least").alias("low"), F.col("most").alias("high"))
    small = counts.join(totals.where(F.col("different") <= RANKED).select("key"), "key", "left_semi")
    found = _ranked(small, asked.where(F.col("different") <= RANKED).select("key", "p", F.col("place").alias("rest")))
    bounds = checkpointed(large)
    if not bounds.isEmpty():
        found = found.union(_narrowed(counts, bounds))
    out = asked.select("key", "p", "n", "least", "most").join(found, ["key", "p"])
    return out.select(F.col("key").alias(key), "p", "percentile", "n", "least", "most")


def _ranked(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, p, percentile): of each key's counted values the one that holds the place ``rest``."""
    upto = Window.partitionBy("key").orderBy("value")
    ranked = counts.withColumn("end", F.sum("c").over(upto))
    held = (F.col("end") > F.col("rest")) & (F.col("end") - F.col("c") <= F.col("rest"))
    return ranked.join(asked, "key").where(held).select("key", "p", F.col("value").alias("percentile"))


def _within(counts: DataFrame, bounds: DataFrame) -> DataFrame:
    """The counted values between each rank's bounds."""
    return counts.join(F.broadcast(bounds), "key").where(F.col("value").between(F.col("low"), F.col("high")))


def _narrowed(counts: DataFrame, bounds: DataFrame) -> DataFrame:
    """(key, p, percentile) of large keys; ``bounds`` has the values between which each rank lies, and the rows below them."""
    grid = F.array(*(F.lit(i / PARTS) for i in range(1, PARTS)))
    while True:
        left = _within(counts, bounds).groupBy("key", "p").agg(F.count("*").alias("different"))
        open_ = left.where(F.col("different") > RANKED).select("key", "p")
        if open_.isEmpty():
            break
        cuts = _within(counts, bounds.join(open_, ["key", "p"])).groupBy("key", "p").agg(F.array_distinct(F.percentile_approx("value", grid, 10_000)).alias("cuts"))
        marked = bounds.join(cuts, ["key", "p"], "left")
        # The part of a value is the number of cuts below it; a value that is a cut ends its part.
        part: Column = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("cuts", lambda x: x < F.col("value"))))
        sums = _within(counts, marked).groupBy("key", "p", part.alias("part")).agg(
            F.sum("c").alias("c"), F.first("place").alias("place"), F.first("below").alias("below"), F.min("value").alias("low"), F.max("value").alias("high")
        )  # at most PARTS rows a rank
        before = Window.partitionBy("key", "p").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        placed = sums.withColumn("under", F.col("below") + F.coalesce(F.sum("c").over(before), F.lit(0)))
        here = (F.col("under") <= F.col("place")) & (F.col("place") < F.col("under") + F.col("c"))
        old, bounds = bounds, checkpointed(placed.where(here).select("key", "p", "place", F.col("under").alias("below"), "low", "high"))
        discarded(old)
    inside = _within(counts, bounds).select(F.struct("key", "p").alias("key"), "value", "c")
    asked = bounds.select(F.struct("key", "p").alias("key"), "p", (F.col("place") - F.col("below")).alias("rest"))
    return _ranked(inside, asked).select("key.key", "p", "percentile")
