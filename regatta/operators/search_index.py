"""Full-text search over an inverted index, scored as ``catalog.relevance`` scores.

The index is a table of posting lists: a row per word and block of documents,
with how often each document of the block holds the word.  It is laid out by
buckets of words, so that a search reads the few buckets of its words and, in
them, the row groups of these words.  Documents of one block are about as long
as each other; every list carries the best score that a document of it can
have from its word, less the word's weight.  A search scores the blocks with
the best bounds first, takes the k-th score found there, and then reads the
lists of those other blocks only that can still beat it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regatta.operators.storage import checkpointed, discarded

#: Parameters of BM25 (fixed values).
K, B = 1.2, 0.75
#: Documents that a block should have.
BLOCK = 4096
#: Documents whose words are counted at a time.
COUNTED = 256
#: Slack for rounding where bounds are compared with scores.
ROUNDING = 1e-9


def words_of(query: str) -> list[str]:
    """The distinct words of a query in order."""
    return sorted({w for w in re.split(r"\W+", query.lower()) if w})


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\W+"), lambda t: t != "")


def _share(n, length, mean):
    """What a word's count contributes to a score, before the word's weight; of columns or of arrays."""
    return n * (K + 1) / (n + K * (1 - B + B * length / mean))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, length, words, counts) of rows (key, tokens): the different words of a document and how often it holds each."""
    for batch in batches:
        for at in range(0, batch.num_rows, COUNTED):
            part = batch.slice(at, COUNTED)
            tokens = part.column("tokens")
            length = np.diff(tokens.offsets.to_numpy())
            coded = tokens.flatten().dictionary_encode()
            known = max(1, len(coded.dictionary))
            # One number for each document and word, so that equal ones are counted by a sort.
            pairs, n = np.unique(np.repeat(np.arange(part.num_rows), length) * known + coded.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(part.num_rows + 1) * known), pa.int32())
            words = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(pairs % known)))
            counts = pa.ListArray.from_arrays(ends, pa.array(n, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(length, pa.int32()), words, counts], names=["key", "length", "words", "counts"])


def _listed(mean: float):
    """The list of each (word, block) from rows of which those of a list follow each other; one that goes on in the next batch waits for it."""

    def lists(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        n, length = rows.column("n"), rows.column("length")
        best = np.maximum.reduceat(_share(n.to_numpy(), length.to_numpy(), mean), starts)
        ends = pa.array(np.append(starts, rows.num_rows), pa.int32())
        entries = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([rows.column("key"), n, length], names=["key", "n", "length"]))
        firsts = [rows.column(c).take(pa.array(starts)) for c in ("word", "block", "bucket")]
        held = pa.array(np.diff(np.append(starts, rows.num_rows)), pa.int64())
        return pa.RecordBatch.from_arrays([*firsts[:2], held, pa.array(best), entries, firsts[2]], names=["word", "block", "held", "best", "entries", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            rows = batch if left is None else pa.concat_batches([left, batch])
            if rows.num_rows == 0:
                continue
            new = [pc.not_equal(rows.column(c).slice(1), rows.column(c).slice(0, rows.num_rows - 1)) for c in ("word", "block")]
            starts = np.append(0, np.flatnonzero(pc.or_(*new).to_numpy(zero_copy_only=False)) + 1)
            left = rows.slice(starts[-1])
            if len(starts) > 1:
                yield lists(rows.slice(0, starts[-1]), starts[:-1])
        if left is not None:
            yield lists(left, np.zeros(1, "int64"))

    return run


@dataclass(frozen=True)
class SearchIndex:
    """An index on disk, below ``path``; ``buckets`` is how many folders its words are dealt to."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def bucket(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.buckets)).cast("int")

    def build(self, docs: DataFrame, key: str, text: str) -> SearchIndex:
        """Write the lists of a table of documents; null texts have no words but count as documents.

        Keys must not repeat.  Texts are split once, and a document's words are
        counted where it is split; the counts are shuffled once, to the task
        that writes their list.  A list holds one block's documents.
        """
        dealt = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartition("key")
        split = dealt.select("key", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
        kind = split.schema["key"].dataType.simpleString()
        counted = checkpointed(split.mapInArrow(_counted, f"key {kind}, length int, words array<string>, counts array<bigint>"))
        totals = counted.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"), F.max("key").alias("key"))
        totals.write.mode("overwrite").parquet(f"{self.path}/totals")
        n, mean = self._totals()
        # Documents of a band have lengths of the same power of two; a band is dealt into blocks by a hash of the key.
        band = F.floor(F.log2(F.col("length") + 1)).cast("int")
        bands = counted.groupBy(band.alias("band")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("blocks"))
        placed = counted.withColumn("band", band).join(F.broadcast(bands), "band")  # one row a power of two
        block = F.format_string("%02d-%08d", "band", F.pmod(F.xxhash64("key"), F.col("blocks")))
        # A word that every document holds has a list in every block, so a bucket is shared by the more tasks, the more blocks there are.
        spread = F.pmod(F.xxhash64("block"), F.lit(-(-n // (256 * BLOCK)) or 1))
        placed = placed.withColumn("block", block).withColumn("spread", spread)
        each = placed.select("key", "length", "block", "spread", F.explode(F.arrays_zip("words", "counts")).alias("w"))
        held = each.select("key", "length", "block", "spread", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
        parts = held.withColumn("bucket", self.bucket(F.col("word"))).repartition("bucket", "spread")
        # Rows of a list follow each other by a hash, which is a sort of longs; lists with equal hashes would only be cut into several.
        parts = parts.sortWithinPartitions(F.xxhash64("word", "block"))
        lists = parts.drop("spread").mapInArrow(_listed(mean), self._schema(kind)).sortWithinPartitions("bucket", "word", "block")
        lists.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/lists")
        discarded(counted)
        return self

    def _totals(self) -> tuple[int, float]:
        row = self.spark.read.parquet(f"{self.path}/totals").first()
        return int(row["docs"]), float(row["mean"] or 0.0)

    @staticmethod
    def _schema(key: str) -> str:
        return f"word string, block string, held bigint, best double, entries array<struct<key:{key},n:bigint,length:int>>, bucket int"

    def lists_of(self, words: list[str]) -> DataFrame:
        """The lists of some words: other buckets are not read, other words' row groups are skipped."""
        key = self.spark.read.parquet(f"{self.path}/totals").schema["key"].dataType.simpleString()
        buckets = list(self.spark.range(1).select(*(self.bucket(F.lit(w)).alias(f"b{i}") for i, w in enumerate(words))).first()) if words else []
        return self.spark.read.schema(self._schema(key)).parquet(f"{self.path}/lists").where(F.col("bucket").isin(buckets) & F.col("word").isin(words))

    def _weighed(self, words: list[str]) -> dict[str, float]:
        """Weight of each word that any document holds: the rarer, the more."""
        docs, _ = self._totals()
        d = self.lists_of(words).groupBy("word").agg(F.sum("held").alias("d"))
        weight = F.log(1 + (F.lit(docs) - F.col("d") + 0.5) / (F.col("d") + 0.5))
        return {r["word"]: r["weight"] for r in d.select("word", weight.alias("weight")).collect()}

    def scored(self, query: str, blocks: DataFrame | None = None) -> DataFrame:
        """(key, score) of all documents that hold a word of the query, or of those in some blocks."""
        weights = self._weighed(words_of(query))
        _, mean = self._totals()
        lists = self.lists_of(sorted(weights))
        lists = lists if blocks is None else lists.join(blocks.select("block"), "block", "left_semi")
        rows = lists.select("word", F.explode("entries").alias("e")).select("word", "e.key", _share(F.col("e.n"), F.col("e.length"), F.lit(mean)).alias("share"))
        one = lambda w: F.coalesce(F.max(F.when(F.col("word") == w, F.col("share"))), F.lit(0.0)) * weights[w]
        score = reduce(lambda a, b: a + b, map(one, sorted(weights)), F.lit(0.0))
        return rows.groupBy("key").agg(score.alias("score"))

    def search(self, query: str, k: int = 10) -> DataFrame:
        """(key, score, rank): the ``k`` best documents, ties by key, without reading lists that cannot hold any of them."""
        weights = self._weighed(words_of(query))
        if not weights or k < 1:
            return self.scored(query).where("false").withColumn("rank", F.lit(0))
        cases = reduce(lambda c, w: c.when(F.col("word") == w, F.col("best") * weights[w]), weights, F.when(F.lit(False), F.lit(0.0)))
        bounds = self.lists_of(sorted(weights)).groupBy("block").agg(F.sum(cases).alias("bound"))
        # A block with a bound has a document at least, so the k best blocks hold k documents if there are so many.
        promising = bounds.orderBy(F.desc("bound"), "block").limit(k)
        first = self.scored(query, F.broadcast(promising)).orderBy(F.desc("score"), "key").limit(k).collect()
        least = first[-1]["score"] if len(first) == k else 0.0
        open_ = bounds.where(F.col("bound") >= least - ROUNDING)
        best = self.scored(query, open_).orderBy(F.desc("score"), "key").limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key")))  # k rows
