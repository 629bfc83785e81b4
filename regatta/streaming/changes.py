"""Change detection over document versions, and the events that tell of changes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds after which a hash that no version confirmed is forgotten.
REMEMBERED = 30 * 24 * 3600


class _LastHash(StatefulProcessor):
    """State of a key: its last hash, which the state store drops when it was not written for ``REMEMBERED`` seconds."""

    def __init__(self, at: str | None):
        self.at = at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "content_hash string", REMEMBERED * 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.last.get()[0] if self.last.exists() else None
        if self.at:
            rows = sorted(rows, key=lambda r: (r[self.at] is not None, r[self.at], r.content_hash) if r[self.at] else (False, 0, r.content_hash))
        for row in rows:
            if row.content_hash != known:
                yield Row(key=key[0], change_type="NEW" if known is None else "MODIFIED", content_hash=row.content_hash)
                known = row.content_hash
        if known is not None:
            self.last.update((known,))

    def close(self) -> None:
        pass


def detected_changes(docs: DataFrame, at: str | None = None) -> DataFrame:
    """NEW or MODIFIED for each document version of a stream (key, content_hash); unchanged ones are dropped.

    Rows of a key in a batch take their turn by the column ``at`` (nulls first,
    ties by hash), or as they come without one, and only the key's last hash
    is kept.  The state expires by itself, so keys
    that are gone do not stay for ever.  Null hashes are no versions.  Start it
    with RocksDB as the state store (``monitor.drained`` does so).
    """
    versions = docs.where("content_hash is not null")
    return versions.groupBy("key").transformWithState(_LastHash(at), "key string, change_type string, content_hash string", "append", "ProcessingTime")


def update_checks(known: DataFrame, fetched: DataFrame, key: str = "key") -> DataFrame:
    """Whether known documents changed: the new hash differs; one that could not be fetched (no row or no hash) did not."""
    new = fetched.select(key, F.col("content_hash").alias("new_hash"))
    met = known.join(new, key, "left")
    return met.select(key, F.coalesce(F.col("new_hash") != F.col("content_hash"), F.col("new_hash").isNotNull()).alias("changed"), "new_hash")


def change_events(changes: DataFrame, detected_at: Column) -> DataFrame:
    """Messages (key, value, topic) that tell of changes of regulations."""
    value = F.to_json(
        F.struct(
            F.lit("regulatory_change").alias("event_type"), "regulation_id", "change_type", "severity", "summary",
            F.date_format(detected_at, "yyyy-MM-dd'T'HH:mm:ss").alias("detected_at"),
        )
    )
    return changes.select(F.col("regulation_id").alias("key"), value.alias("value"), F.lit("regulations.updates").alias("topic"))


#: The jobs that watch sources by default: id, source, jurisdiction, document types, hours between two runs (fixed values).
DEFAULT_JOBS = (
    ("us_federal_rules", "federal_register", "US", ["rule", "proposed_rule"], 24), ("eu_regulations", "eurlex", "EU", ["regulation", "directive"], 24),
)


def due_jobs(jobs: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Enabled jobs that never ran or whose last run lies at least their interval back.

    ``jobs``: id, hours, enabled; ``runs``: id, at.  A trigger every minute asks
    for them; one job's failure is a row of ``runs`` like any other.
    """
    last = runs.groupBy("id").agg(F.max("at").alias("last_run"))
    met = jobs.join(last, "id", "left")
    back = now - F.make_dt_interval(hours=F.col("hours"))
    return met.where(F.col("enabled") & (F.col("last_run").isNull() | (F.col("last_run") <= back)))
