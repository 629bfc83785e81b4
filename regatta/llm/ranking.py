"""Exact ranks within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: list[str], order: list[str], seed: int = 42, buckets: int = 1024, name: str = "rank") -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in a seeded pseudo-random order.

    Rows are dealt to ``buckets`` hash buckets per group; each bucket is
    numbered by itself and starts after the counts of the buckets before it,
    so a group that holds a third of all rows spreads over many tasks.
    ``order`` are the columns that identify a row; rows equal in all of them
    are interchangeable.  Null group values form groups.
    """
    mixed = df.withColumn("_h", F.xxhash64(F.lit(seed), *order)).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sizes = mixed.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # Each bucket's start comes first among its rows, so that no table of starts is joined or broadcast.
    both = mixed.unionByName(starts, allowMissingColumns=True)
    within = Window.partitionBy(*group, "_b").orderBy(F.desc_nulls_last("_start"), "_h", *order)
    numbered = both.withColumns({"_rn": F.row_number().over(within), "_at": F.first("_start").over(within)}).where("_start is null")
    return numbered.withColumn(name, F.col("_at") + F.col("_rn") - 2).drop("_h", "_b", "_rn", "_at", "_start")
