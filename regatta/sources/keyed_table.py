"""Tables on disk that are changed by key: only the buckets of changed keys are rewritten."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.operators.mutations import updated, upserted
from regatta.operators.storage import checkpointed, discarded


@dataclass(frozen=True)
class KeyedTable:
    """Parquet files below ``path`` in ``buckets`` folders by a hash of ``key``, which tells rows apart."""

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    schema: str
    buckets: int = 64

    def _placed(self, rows: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        return rows.select(*self.columns).withColumn("bucket", bucket)

    @property
    def columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def read(self) -> DataFrame:
        return self._raw().drop("bucket")

    def _raw(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)

    def _write(self, rows: DataFrame, mode: str) -> None:
        writer = rows.repartition("bucket").write.mode(mode).partitionBy("bucket")
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def create(self, rows: DataFrame) -> KeyedTable:
        """Write the table anew."""
        self._placed(rows).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(self.path)
        return self

    def append(self, rows: DataFrame, *checks: tuple[str, str]) -> DataFrame:
        """Add rows that pass all checks (reason, condition) and whose key is new; returns those that do not, with the first reason.

        A null condition fails.  Of rows that repeat a key within the batch
        none is added.  New files are added to buckets; old ones stay.
        """
        reason = F.coalesce(*(F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(r)) for r, c in checks), F.lit(None).cast("string"))
        placed = self._placed(rows).withColumn("reason", reason)
        again = placed.groupBy(*self.key).agg((F.count("*") > 1).alias("again"))
        known = self._raw().join(F.broadcast(placed.select("bucket").distinct()), "bucket", "left_semi").select(*self.key, F.lit(True).alias("known"))
        judged = placed.join(again, list(self.key), "left").join(known, list(self.key), "left")
        twice = F.coalesce("known", F.col("again"), F.lit(False))
        judged = checkpointed(judged.withColumn("reason", F.coalesce("reason", F.when(twice, "key exists"))).drop("again", "known"))
        self._write(judged.where("reason is null").drop("reason"), "append")
        return judged.where("reason is not null").drop("bucket")

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of their key and are added otherwise; keys must not repeat among them."""
        self._change(rows, lambda old, new: upserted(old, new, list(self.key)))

    def update(self, rows: DataFrame) -> None:
        """Values that are not null replace those of their key; unknown keys are passed over, missing columns stay."""
        missing = [F.lit(None).cast(t).alias(c) for c, t in self._types().items() if c not in rows.columns]
        self._change(rows.select("*", *missing), lambda old, new: updated(old, new, list(self.key)))

    def _types(self) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self.spark.createDataFrame([], self.schema).schema.fields}

    def delete(self, keys: DataFrame) -> None:
        """Rows of these keys go."""
        self._change(keys.select(*self.key, *(F.lit(None).cast(t).alias(c) for c, t in self._types().items() if c not in self.key)), lambda old, new: old.join(new, list(self.key), "left_anti"))

    def _change(self, rows: DataFrame, change) -> None:
        """Rewrite the buckets that hold a changed key, at most ``buckets``, from a copy of what they become."""
        new = checkpointed(self._placed(rows))
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
        if touched:
            old = self._raw().where(F.col("bucket").isin(touched))
            whole = checkpointed(self._placed(change(old.drop("bucket"), new.drop("bucket"))))
            self._write(whole, "overwrite")
            left = {r["bucket"] for r in whole.select("bucket").distinct().collect()}
            self._clear([b for b in touched if b not in left])
            discarded(whole)
        discarded(new)

    def _clear(self, empty: list[int]) -> None:
        """Remove the folders of buckets that have no row any more, which an overwrite of partitions leaves as they were."""
        for b in empty:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
