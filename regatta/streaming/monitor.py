"""Streaming operators: routing, metric series, change detection, alerts, rate limits.

Watermarks are an addition of this engine: event-time operators wait ten
minutes for late rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regatta.operators.scan import in_turn, with_previous
from regatta.operators.scoring import zk_tier
from regatta.sources.domain import mapped
from regatta.streaming.session import PROVIDER, ROCKSDB, settings

LATE = "10 minutes"
#: Topic of each event type; others go to the default topic.
TOPICS = {
    "assessment.started": "compliance.assessments", "assessment.completed": "compliance.assessments", "score.calculated": "compliance.scores",
    "tier.changed": "compliance.tiers", "violation.detected": "compliance.violations", "requirement.met": "compliance.requirements",
    "regulation.updated": "regulations.updates", "proof.generated": "verification.proofs", "credential.issued": "verification.credentials",
    "entity.created": "entities.changes", "entity.updated": "entities.changes",
}
DEFAULT_TOPIC = "compliance.events"


#: Severity of the events that a rule watches; others only inform.
SEVERITIES = {"violation.detected": "critical", "tier.changed": "high"}


def routed(events: DataFrame) -> DataFrame:
    """Key, topic, severity and JSON value of each event, ready for a Kafka or file sink; batch or stream."""
    topic = F.coalesce(mapped(F.col("event_type"), TOPICS), F.lit(DEFAULT_TOPIC))
    severity = F.coalesce(mapped(F.col("event_type"), SEVERITIES), F.lit("info")).alias("severity")
    value = F.to_json(F.struct("event_id", "event_type", "entity_id", "score", severity))
    return events.select("event_id", F.col("entity_id").cast("string").alias("key"), topic.alias("topic"), severity, value.alias("value"))


def quarantined(messages: DataFrame, schema: str, needed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Messages (value) that parse and have every needed field, and those that do not, with the reason.

    One bad message never stops a batch; both sides work on streams as well.
    """
    parsed = messages.withColumn("_m", F.from_json("value", schema))
    missing = F.concat_ws(", ", *(F.when(F.col(f"_m.{c}").isNull(), F.lit(c)) for c in needed))
    broken = F.try_parse_json("value").isNull()
    reason = F.when(broken, "not JSON").when(missing != "", F.concat(F.lit("missing "), missing))
    judged = parsed.withColumn("reason", reason)
    return judged.where("reason is null").select("_m.*"), judged.where("reason is not null").select(*messages.columns, "reason")


def recent_events(
    events: DataFrame, entity_id: int | None = None, event_types: list[str] | None = None, since: str | None = None, limit: int = 50
) -> DataFrame:
    """The latest events by the given filters, newest first."""
    rows = events if entity_id is None else events.where(F.col("entity_id") == entity_id)
    rows = rows.where(F.col("event_type").isin(event_types)) if event_types else rows
    rows = rows.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")) if since else rows
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def metric_series(events: DataFrame, interval: str = "1 day") -> DataFrame:
    """Count, sum, mean and extremes of scores in tumbling windows; with a watermark on a stream."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE) if events.isStreaming else events
    score = F.col("score")
    series = source.groupBy(F.window("ts", interval).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum(score).alias("score_sum"), F.round(F.avg(score), 6).alias("score_avg"),
        F.min(score).alias("score_min"), F.max(score).alias("score_max"),
    )
    return series.select(F.col("w.start").alias("window_start"), *[c for c in series.columns if c != "w"])


def cooled(times: list[float], minutes: float = 60) -> list[bool]:
    """Which of some ascending times (seconds) raise an alert: each mutes those of the next ``minutes``."""
    out, last = [], None
    for t in times:
        fires = last is None or t - last >= minutes * 60
        last = t if fires else last
        out.append(fires)
    return out


#: Severity of the rules.
RULES = {"violation": "critical", "score_drop": "high", "tier_downgrade": "high"}


def rule_hits(events: DataFrame, drop: int = 1000) -> DataFrame:
    """Events that meet a rule: violations, scores that fall by more than ``drop``, and scores of a lower tier than the one before; a null score meets none."""
    scores = events.where("event_type = 'score.calculated'")
    scored = with_previous(scores, ["entity_id"], ["ts", "event_id"], {"_before": "score"}).where("_before is not null and score is not null")
    hit = lambda rows, rule: rows.select("event_id", "entity_id", "ts", F.lit(rule).alias("rule"))
    found = hit(events.where("event_type = 'violation.detected'"), "violation")
    found = found.union(hit(scored.where(F.col("score") - F.col("_before") < -drop), "score_drop"))
    return found.union(hit(scored.where(zk_tier(F.col("score")) > zk_tier(F.col("_before"))), "tier_downgrade"))


def alerts(events: DataFrame, drop: int = 1000, minutes: float = 60) -> DataFrame:
    """Alerts of a batch of events, with a cooldown per entity and rule and the rule's severity."""

    def fire(last: float | None, t: float) -> tuple[float, bool]:
        fires = last is None or t - last >= minutes * 60
        return (t if fires else last), fires

    fired = in_turn(rule_hits(events, drop), ["entity_id", "rule"], fire, "_fires").where("_fires").drop("_fires")
    return fired.withColumn("severity", mapped(F.col("rule"), RULES))


def alert_states(alerts: DataFrame, updates: DataFrame) -> DataFrame:
    """Alerts with the state that people gave them.

    ``updates``: alert_id, action (acknowledge, resolve, suppress), user, note,
    at.  The latest action decides the status, open without any; who
    acknowledged and who resolved is kept.
    """
    of = lambda action, c: F.max_by(F.when(F.col("action") == action, F.col(c)), F.when(F.col("action") == action, F.col("at")))
    last = updates.groupBy("alert_id").agg(
        F.max_by("action", "at").alias("_last"), of("acknowledge", "user").alias("acknowledged_by"), of("resolve", "user").alias("resolved_by"),
        of("resolve", "note").alias("resolution"), F.max("at").alias("updated_at"),
    )
    states = {"acknowledge": "acknowledged", "resolve": "resolved", "suppress": "suppressed"}
    met = alerts.join(last, "alert_id", "left")
    return met.withColumn("status", F.coalesce(mapped(F.col("_last"), states), F.lit("open"))).drop("_last")


def limited(events: DataFrame, per_window: int = 100, seconds: int = 60) -> DataFrame:
    """Whether each request is within the limit of its entity's fixed window, which opens with its first request."""

    def admit(state: tuple[float, int] | None, t: float) -> tuple[tuple[float, int], bool]:
        opened, used = state if state is not None and t - state[0] < seconds else (t, 0)
        return (opened, used + 1), used + 1 <= per_window

    return in_turn(events.select("event_id", "entity_id", F.col("ts").cast("timestamp").alias("ts")), ["entity_id"], admit, "allowed")


STATUSES, LEVELS = ("open", "acknowledged", "resolved", "suppressed"), ("low", "medium", "high", "critical")


def alert_totals(alerts: DataFrame) -> DataFrame:
    """Alerts by status and by severity as rows (kind, value, n), with 0 for what none has; one pass over them."""
    each = F.array(F.struct(F.lit("status").alias("kind"), F.col("status").alias("value")), F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("value")))
    counts = alerts.select(F.explode(each).alias("_x")).select("_x.*").groupBy("kind", "value").agg(F.count("*").alias("n"))
    names = [("status", v) for v in STATUSES] + [("severity", v) for v in LEVELS]
    known = alerts.sparkSession.createDataFrame(names, "kind string, value string")
    return known.join(counts, ["kind", "value"], "left").fillna(0, ["n"])


#: Periods that are looked back on, in hours.
PERIODS = {"1h": 1, "6h": 6, "24h": 24, "7d": 168, "30d": 720}


def looking_back(events: DataFrame, as_of: Column, key: str = "entity_id") -> DataFrame:
    """Count, sum, mean and extremes of the scores of each key in each period before a time.

    An event is aggregated once, in the shortest period that holds it; the
    longer ones then add up the few partial sums of a key.
    """
    hours = F.lit(None).cast("int")
    for h in sorted(PERIODS.values(), reverse=True):
        hours = F.when(F.col("ts") >= as_of - F.make_dt_interval(hours=F.lit(h)), h).otherwise(hours)
    score = F.col("score").cast("bigint")
    part = events.where(F.col("ts") < as_of).withColumn("_hours", hours).where("_hours is not null").groupBy(key, "_hours").agg(
        F.count(score).alias("_n"), F.sum(score).alias("_s"), F.min("score").alias("_low"), F.max("score").alias("_high")
    )
    periods = F.array(*(F.struct(F.lit(p).alias("period"), F.lit(h).alias("hours")) for p, h in PERIODS.items()))
    each = part.withColumn("_p", F.explode(F.filter(periods, lambda p: p["hours"] >= F.col("_hours"))))
    return each.groupBy(F.col("_p.period").alias("period"), key).agg(
        F.sum("_n").alias("n"), F.sum("_s").alias("total"), F.min("_low").alias("least"), F.max("_high").alias("most"), F.round(F.sum("_s") / F.sum("_n"), 6).alias("mean")
    )


def system_metrics(events: DataFrame, entities: DataFrame, as_of: Column) -> DataFrame:
    """One row on the whole system: entities in all and active ones, mean score, scores by numeric tier, and the last 24 hours."""
    tier, recent = zk_tier(F.col("score")), F.col("ts") >= as_of - F.make_dt_interval(hours=F.lit(24))
    of = lambda c, name: F.count(F.when(c, 1)).alias(name)
    row = events.agg(
        F.countDistinct("entity_id").alias("active_entities"), F.round(F.avg("score"), 6).alias("mean_score"), *(of(tier == t, f"tier_{t}") for t in range(1, 6)),
        of((F.col("event_type") == "assessment.completed") & recent, "assessments_24h"), of((F.col("event_type") == "violation.detected") & recent, "violations_24h"),
    )
    return row.crossJoin(entities.agg(F.count("*").alias("total_entities")))  # one row each


def drained(stream: DataFrame, path: str, checkpoint: str, empty_batches: bool = True, name: str | None = None) -> None:
    """Run a stream over all that its source has now, into Parquet files; state is kept in RocksDB.

    Batches without rows close windows; a stream whose state expires by the
    clock would ask for them for ever and must run without.
    """
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    query = (query.queryName(name) if name else query).outputMode("append").trigger(availableNow=True)
    with settings(stream.sparkSession, {"spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower(), PROVIDER: ROCKSDB}):
        query.start().awaitTermination()


def progress_of(sources: list) -> dict[str, float]:
    """Rows of a batch, rate, and lag (newest offset less the one read, where a source tells both) over the sources of a stream."""
    rows, rate, lag = 0, 0.0, 0
    for source in sources:
        get = source.get if isinstance(source, dict) else lambda k, s=source: getattr(s, k)
        rows += get("numInputRows")
        rate += get("processedRowsPerSecond") or 0.0
        lag += _offsets(get("latestOffset")) - _offsets(get("endOffset")) if get("latestOffset") else 0
    return {"rows": rows, "rows_per_second": rate, "lag": lag}


def _offsets(told: object) -> int:
    """Sum of the offsets of all partitions of all topics; 0 for sources that do not count."""
    if isinstance(told, str):
        try:
            told = json.loads(told)
        except ValueError:
            return 0
    if not isinstance(told, dict):
        return 0
    return sum(n for topic in told.values() if isinstance(topic, dict) for n in topic.values() if isinstance(n, int))


def progress(query: StreamingQuery) -> dict[str, object]:
    """Name, state, and the last batch's rows, rate and lag of a running stream."""
    last = query.lastProgress
    found = progress_of([] if last is None else last["sources"])
    return {"name": query.name, "active": query.isActive, **found, "failed": query.exception() is not None}
