"""The consume loop: messages of a stream handled batch by batch, bad ones set apart, nothing written twice.

And the record of how streams get on, as a table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from regatta.streaming.monitor import progress_of, quarantined


class _Enough(Exception):
    """Raised before a batch that is not to be handled any more; the batch stays uncommitted."""


@dataclass
class Loop:
    """Handles messages (``value``) of a stream until there are no more or enough of them.

    Every batch writes what it handled to ``handled`` and what does not parse
    or lacks a field to ``rejected``, each in a folder named by the batch's
    number.  A batch that is run again after a failure has the same number and
    the same messages, and replaces its two folders: each message is in one of
    them once.  ``handle`` may transform good messages before they are written.
    """

    handled: str
    rejected: str
    schema: str
    needed: tuple[str, ...]
    handle: Callable[[DataFrame], DataFrame] = lambda rows: rows
    counts: dict[int, int] = field(default_factory=dict)

    def write(self, batch: DataFrame, number: int) -> None:
        """Write both sides of a batch and count the good messages, which are read but once from the source."""
        spark, kept = batch.sparkSession, batch.persist()
        try:
            good, bad = quarantined(kept, self.schema, self.needed)
            for rows, path in ((self.handle(good), self.handled), (bad, self.rejected)):
                rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            kept.unpersist()
        self.counts[number] = spark.read.parquet(f"{self.handled}/batch={number}").count()

    def run(self, messages: DataFrame, checkpoint: str, max_messages: int | None = None) -> int:
        """Run over all that the source has now; returns the number of messages handled.

        After ``max_messages`` no further batch is begun: a batch is handled
        whole, and the next one is the first of the next run.  Limit the
        source (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) for batches
        that are small enough.
        """
        before, enough = sum(self.counts.values()), []

        def one(batch: DataFrame, number: int) -> None:
            if max_messages is not None and sum(self.counts.values()) - before >= max_messages:
                enough.append(number)
                raise _Enough
            self.write(batch, number)

        query = messages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if not enough:
                raise
        return sum(self.counts.values()) - before


PROGRESS = "name string, run_id string, batch_id bigint, rows bigint, rows_per_second double, lag bigint, failed boolean"


class Recorder(StreamingQueryListener):
    """Collects a row for each batch of each stream of the session, and one more when a stream fails."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.ended: set[str] = set()
        self.names: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.names[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        found = progress_of(p.sources)
        self.rows.append((p.name, str(p.runId), p.batchId, found["rows"], found["rows_per_second"], found["lag"], False))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        run = str(event.runId)
        if event.exception is not None:
            self.rows.append((self.names.get(run), run, None, 0, 0.0, 0, True))
        self.ended.add(run)


@contextmanager
def recorded(spark: SparkSession, path: str, wait: float = 10.0) -> Iterator[Recorder]:
    """Record the progress of the streams that run inside, and append it to a table (``PROGRESS``) afterwards.

    Spark tells of progress some time later; at the end up to ``wait`` seconds
    are given for the ends of all streams to be told.
    """
    recorder = Recorder()
    spark.streams.addListener(recorder)
    try:
        yield recorder
    finally:
        until = time.monotonic() + wait
        while set(recorder.names) - recorder.ended and time.monotonic() < until:
            time.sleep(0.05)
        spark.streams.removeListener(recorder)
        spark.createDataFrame(recorder.rows, PROGRESS).coalesce(1).write.mode("append").parquet(path)


def unsubscribed(spark: SparkSession, name: str) -> bool:
    """Stop the running streams of a name; false if there is none."""
    found: list[StreamingQuery] = [q for q in spark.streams.active if q.name == name]
    for q in found:
        q.stop()
    return bool(found)
