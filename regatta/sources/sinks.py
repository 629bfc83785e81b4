"""Publishing to topics, tables with an expiry, dated metric tables and files of any format."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regatta.functions.pages import file_format
from regatta.operators.storage import checkpointed


@dataclass(frozen=True)
class Sink:
    """Where messages go: a Spark format with its options.

    Files are laid out by topic; ``kafka`` takes the topic from the column.
    """

    format: str = "json"
    options: dict[str, str] = field(default_factory=dict)

    def write(self, messages: DataFrame) -> None:
        """Append a batch of messages (key, value, topic)."""
        writer = messages.select("key", "value", "topic").write.format(self.format).options(**self.options).mode("append")
        (writer if self.format == "kafka" else writer.partitionBy("topic")).save()

    def start(self, messages: DataFrame, checkpoint: str, name: str | None = None) -> StreamingQuery:
        """Publish a stream of messages until it is stopped; restarts go on from ``checkpoint``."""
        writer = messages.select("key", "value", "topic").writeStream.format(self.format).options(**self.options).option("checkpointLocation", checkpoint)
        writer = writer if self.format == "kafka" else writer.partitionBy("topic")
        return (writer.queryName(name) if name else writer).outputMode("append").start()


def kafka_producer(servers: str) -> Sink:
    """Compressed, acknowledged by all replicas, three retries."""
    return Sink("kafka", {"kafka.bootstrap.servers": servers, "kafka.acks": "all", "kafka.retries": "3", "kafka.compression.type": "gzip"})


def published(messages: DataFrame, sink: Sink) -> DataFrame:
    """Publish a batch and count what was sent to each topic; the messages are computed once."""
    kept = checkpointed(messages)
    sink.write(kept)
    return kept.groupBy("topic").agg(F.count("*").alias("sent"))


def consumer_options(servers: str, topics: list[str], group: str, from_beginning: bool = False, max_messages: int | None = None) -> dict[str, str]:
    """Options of a Kafka source: offsets to start from, and how many messages a batch may take."""
    options = {
        "kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "kafka.group.id": group, "startingOffsets": "earliest" if from_beginning else "latest",
    }
    return options | ({"maxOffsetsPerTrigger": str(max_messages)} if max_messages else {})


def with_expiry(rows: DataFrame, now: Column, seconds: int | None) -> DataFrame:
    """Entries (key, value) of a cache with the time at which they end; without ``seconds`` they never do."""
    until = F.lit(None).cast("timestamp_ntz") if seconds is None else now + F.make_dt_interval(secs=F.lit(seconds))
    return rows.withColumn("expires_at", until)


def unexpired(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def without_keys(cache: DataFrame, pattern: str) -> DataFrame:
    """Entries whose key does not match a pattern with * and ? as wildcards."""
    special = {"*": ".*", "?": "."}
    regex = "".join(special.get(c, "\\" + c if not c.isalnum() else c) for c in pattern)
    return cache.where(~F.col("key").rlike(f"^{regex}$"))


def write_dated(rows: DataFrame, path: str, at: str = "ts") -> None:
    """Append to a table that is laid out by day, so that reads of a period touch its days only."""
    day = F.to_date(at)
    rows.withColumn("day", day).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def read_dated(spark: SparkSession, path: str, schema: str, first: str, last: str) -> DataFrame:
    """Rows of the days ``first`` to ``last``; other days' folders are pruned."""
    rows = spark.read.schema(f"{schema}, day date").parquet(path)
    return rows.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def documents_in(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path with their format and, where they hold text, the text; other formats stay bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = file_format(F.col("path"), F.col("content"))
    text = F.when(kind.isin("html", "text", "markdown"), F.try_validate_utf8(F.col("content").cast("string")))
    return files.select("path", "length", kind.alias("format"), text.alias("text"), F.col("content"))
