"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regatta.llm.ranking import ranked
from regatta.llm.storage import removed, written
from regatta.llm.words import word_count

#: Words of the budget that the dynamic programme fits; larger remainders are first filled greedily.
FITTED = 1 << 15


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = FITTED) -> np.ndarray:
    """How many documents of each length to take so that their sizes sum as near to ``budget`` as can be.

    Every length first gives the budget's share of its documents, but for a
    rest that is kept back.  The rest is filled from the longest length down
    while it is above ``window`` words, and bounded-knapsack dynamic programming
    over the documents still free fits what is left exactly, or to the nearest
    sum that they can make.  Of more than half of the words, those left out are
    fitted instead, so that there are always enough documents to choose from.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if 2 * budget > total:
        return counts - fit(lengths, counts, total - budget, window)
    back = min(window // 2, max(budget // 8, 2 * int(lengths.max())), budget)
    take = np.array([int(c) * (budget - back) // total for c in counts], np.int64)
    left = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        if size and left > window:
            more = min(int(counts[i] - take[i]), (left - window // 2) // size)
            take[i] += more
            left -= more * size
    return take + _knapsack(lengths, counts - take, left)


def _knapsack(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: reachable sums as bits of one integer, with the step that first reached each."""
    more = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return more
    usable = [i for i in np.argsort(lengths, kind="stable") if free[i] > 0 and lengths[i] > 0]
    limit = 2 * budget  # a sum above the budget can be nearer than any below it
    every = (1 << (limit + 1)) - 1
    reached, steps = 1, []
    via = np.full(limit + 1, -1, np.int64)
    for i in usable:
        size, rest, part = int(lengths[i]), int(free[i]), 1
        while rest and part * size <= limit:
            part = min(part, rest)
            new = (reached << (part * size)) & every & ~reached
            if new:
                bits = np.frombuffer(new.to_bytes(limit // 8 + 1, "little"), np.uint8)
                via[np.flatnonzero(np.unpackbits(bits, bitorder="little")[: limit + 1])] = len(steps)
                steps.append((i, part, size))
                reached |= new
            rest, part = rest - part, 2 * part
        if reached >> budget & 1:
            break
    sums = np.flatnonzero(via >= 0)
    best = int(sums[np.abs(sums - budget).argmin()]) if len(sums) else 0
    if best and abs(best - budget) >= budget:  # taking nothing is as near
        best = 0
    while best:
        i, part, size = steps[via[best]]
        more[i] += part
        best -= part * size
    return more


def source_targets(sizes: DataFrame, weights: tuple[float, ...], limit: float) -> DataFrame:
    """Target of every source from its size.

    ``sizes``: ``source``, ``source_size``.  Sources in code-point order (null
    last) take ``weights`` in turn and share the sum of all sizes; a target
    stops at ``limit`` times its source's size and the excess is shared again
    by weight until none is above.  Each round of sharing is one aggregation;
    only its two sums reach the driver.
    """
    spark = sizes.sparkSession
    ordered = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = written(ordered.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")), "sources")
    parts = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))  # a row per partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    at = (F.col("_start") + F.col("_m") - F.col("_first")) % len(weights)
    turns = F.array(*(F.lit(float(w)) for w in weights))
    weighed = placed.join(starts, "_p").select("source", "source_size", F.element_at(turns, at.cast("int") + 1).alias("weight"))
    weighed = written(weighed, "weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        held = F.col("weight") * level >= limit * F.col("source_size")  # at its limit at this level
        row = weighed.agg(
            F.sum(F.when(held, F.col("source_size")).otherwise(0)), F.sum(F.when(held, 0.0).otherwise(F.col("weight")))
        ).first()
        if not row[1]:
            break
        higher = (total - limit * (row[0] or 0)) / row[1]
        if higher <= level:
            break
        level = higher
    return weighed.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.lit(float(limit)) * F.col("source_size")))


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    limit: float = 3.0,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep_source: bool = False,
) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    A source whose target is r times its size takes every document floor(r)
    times; the remaining budget is fitted by ``fit`` over the source's counts
    of documents by exact length, and the documents of each length that are
    taken once more are the first in a seeded order.

    Returns one row per input row: the id, ``size`` (words), ``source_size``,
    ``target``, ``taken`` (words, a multiple of ``size``) and ``copies`` (and
    ``source`` if ``keep_source``).  A
    null or wordless text has size 0 and is never taken; a null source is a
    source of its own; null ids and repeated rows count like others; extra
    columns are ignored; an empty table gives an empty result.  Reruns agree.

    Only lengths are moved, never texts.  One task fits one source, from its
    distinct lengths, which the longest document bounds.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = written(sized, "sizes")
    lengths = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sums = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sums, weights, limit)

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        size, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        base = min(int(target // size), int(limit)) if size else 0
        extra = fit(frame["size"].to_numpy(), frame["n"].to_numpy(), round(target) - base * size if base < limit else 0)
        return frame.assign(base=base if size else 0, extra=extra)[["source", "size", "source_size", "target", "base", "extra"]]

    same = F.col("source").eqNullSafe(F.col("_source"))
    of_source = lengths.join(targets.withColumnRenamed("source", "_source"), same).drop("_source", "weight")
    source_type = sized.schema["source"].dataType.simpleString()
    chosen = of_source.groupBy("source").applyInPandas(
        fitted, f"source {source_type}, size bigint, source_size bigint, target double, base bigint, extra bigint"
    )
    chosen = written(chosen, "chosen").withColumnsRenamed({"source": "_source", "size": "_size"})
    removed(lengths)
    numbered = ranked(sized, ["source", "size"], ["doc_id"], seed, buckets=256)
    met = numbered.join(chosen.hint("merge"), same & (F.col("size") == F.col("_size")))  # grows with sources and lengths: never a broadcast
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("base") + (F.col("rank") < F.col("extra")).cast("bigint"))
    taken = (F.col("size") * copies).alias("taken")
    return met.select("doc_id", *(["source"] if keep_source else []), "size", "source_size", "target", taken, copies.alias("copies"))
