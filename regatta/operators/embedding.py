"""Embeddings of texts by any provider, each text asked for once and kept under its hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a provider reads of a text at most, in characters, and texts of one call (fixed values).
LONGEST, BATCH = 30_000, 100
SCHEMA = "text_hash string, model string, embedding array<double>"

Provider = Callable[[list[str]], list[list[float]]]


def text_hash(text) -> F.Column:
    """The key of a text: the MD5 of all of it, in hexadecimal."""
    return F.md5(text)


class EmbeddingCache:
    """Embeddings below a folder, by model and the first digits of the hash, so that only wanted files are read."""

    def __init__(self, spark: SparkSession, path: str, model: str):
        self.spark, self.path, self.model = spark, path, model

    def rows(self) -> DataFrame:
        """(text_hash, embedding) of this model; nothing where nothing was kept yet."""
        table = self.spark.read.schema(f"{SCHEMA}, head string")
        try:
            kept = table.parquet(self.path)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], "text_hash string, embedding array<double>")
        return kept.where(F.col("model") == self.model).select("text_hash", "embedding")

    def add(self, missing: DataFrame, provider: Provider, longest: int = LONGEST, batch: int = BATCH) -> None:
        """Ask for the texts (``text_hash``, ``text``, each hash once) and keep what comes back.

        Tasks ask for ``batch`` texts at a time, of which the provider sees
        the first ``longest`` characters.  A task that is run again asks again
        for its own texts, but only one answer is kept.
        """

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), batch):
                    some = frame.iloc[at : at + batch]
                    vectors = provider(some["text"].tolist())
                    if len(vectors) != len(some):
                        raise ValueError(f"asked for {len(some)} embeddings, got {len(vectors)}")
                    yield pd.DataFrame({"text_hash": some["text_hash"], "embedding": [list(map(float, v)) for v in vectors]})

        texts = missing.select("text_hash", F.substring("text", 1, longest).alias("text"))
        found = texts.mapInPandas(ask, "text_hash string, embedding array<double>")
        kept = found.select("text_hash", F.lit(self.model).alias("model"), "embedding", F.substring("text_hash", 1, 2).alias("head"))
        kept.write.mode("append").partitionBy("model", "head").parquet(self.path)


def embedded(texts: DataFrame, provider: Provider, cache: EmbeddingCache, text_col: str = "text", **limits: int) -> DataFrame:
    """The rows with ``text_hash`` and ``embedding``; only texts that the cache does not have reach the provider.

    Null texts have neither.  Equal texts are asked for once, whatever their
    number: their hashes are combined before they are shuffled.  A second run
    over the same texts asks for nothing.
    """
    keyed = texts.withColumn("text_hash", text_hash(F.col(text_col)))
    wanted = keyed.where(F.col("text_hash").isNotNull()).groupBy("text_hash").agg(F.any_value(text_col).alias("text"))
    missing = wanted.join(cache.rows().select("text_hash"), "text_hash", "left_anti")
    cache.add(missing, provider, **limits)
    # A hash may have been kept twice, if two runs asked at the same time.
    once = cache.rows().groupBy("text_hash").agg(F.any_value("embedding").alias("embedding"))
    return keyed.join(once, "text_hash", "left").select(*texts.columns, "text_hash", "embedding")
