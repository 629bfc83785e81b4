"""Queries on events: routing, metrics, trends, alerts, audit chains."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.functions.numbers import ratio, ratio_sql
from regatta.operators.scan import with_previous
from regatta.operators.storage import shared_dir
from regatta.plans.domain_sql import oracle
from regatta.plans.registry import query
from regatta.sources import domain
from regatta.streaming import changes, monitor

TOPIC_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in monitor.TOPICS.items()) + f" else '{monitor.DEFAULT_TOPIC}' end"
SERIES_SQL = oracle(
    """select date_trunc('day', ts) as window_start, event_type, count(*)::bigint as n, sum(score)::bigint as score_sum,
         round(avg(score), 6) as score_avg, min(score) as score_min, max(score) as score_max from compliance_events group by 1, 2"""
)


@query(
    oracle(
        f"""select event_id, entity_id::varchar as key, {TOPIC_SQL} as topic, severity, '{{"event_id":' || event_id || ',"event_type":"' || event_type || '","entity_id":' || entity_id
              || ',"score":' || score || ',"severity":"' || severity || '"}}' as value
            from (select *, case event_type when 'violation.detected' then 'critical' when 'tier.changed' then 'high' else 'info' end as severity from compliance_events)"""
    )
)
def t01_routed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.routed(domain.events(spark, sf_dir))


MESSAGES = """messages as (select event_id, case when event_id % 20 = 0 then '{"event_id":' when event_id % 20 = 1 then '{"event_id":' || event_id || '}'
    else '{"event_id":' || event_id || ',"event_type":"' || event_type || '","entity_id":' || entity_id || '}' end as value from compliance_events)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which one in twenty is cut short and one lacks fields."""
    whole, k = F.to_json(F.struct("event_id", "event_type", "entity_id")), F.col("event_id")
    value = F.when(k % 20 == 0, '{"event_id":').when(k % 20 == 1, F.to_json(F.struct("event_id"))).otherwise(whole)
    return domain.events(spark, sf_dir).select("event_id", value.alias("value"))


@query(
    oracle(
        "select event_id, value, case event_id % 20 when 0 then 'not JSON' else 'missing event_type, entity_id' end as reason from messages where event_id % 20 < 2",
        MESSAGES,
    )
)
def t02_quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.quarantined(messages(spark, sf_dir), "event_id bigint, event_type string, entity_id bigint", ("event_id", "event_type", "entity_id"))[1]


@query(oracle("select event_id, event_type, entity_id from compliance_events where event_id % 20 >= 2"))
def t02_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.quarantined(messages(spark, sf_dir), "event_id bigint, event_type string, entity_id bigint", ("event_id", "event_type", "entity_id"))[0]


@query(
    oracle(
        """select event_id, entity_id, event_type, ts, score from compliance_events where entity_id = 7 and event_type in ('violation.detected', 'score.calculated')
             and ts >= timestamp '2024-01-10' order by ts desc, event_id desc limit 50"""
    )
)
def t08_recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = monitor.recent_events(domain.events(spark, sf_dir), 7, ["violation.detected", "score.calculated"], "2024-01-10 00:00:00")
    return found.select("event_id", "entity_id", "event_type", "ts", "score")


@query(
    oracle(
        """select event_id as alert_id, entity_id, case when event_id % 5 = 0 then 'suppressed' when event_id % 3 = 0 then 'resolved' when event_id % 2 = 0 then 'acknowledged' else 'open' end as status,
             case when event_id % 2 = 0 then 'first' end as acknowledged_by, case when event_id % 3 = 0 then 'second' end as resolved_by,
             case when event_id % 3 = 0 then 'done' end as resolution,
             case when event_id % 5 = 0 then 3 when event_id % 3 = 0 then 2 when event_id % 2 = 0 then 1 end::int as updated_at
           from compliance_events where event_type = 'violation.detected'"""
    )
)
def t10_alert_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alert_states(spark, sf_dir)


def _alert_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of violations after some were acknowledged, resolved or suppressed, in this order."""
    alerts = domain.events(spark, sf_dir).where("event_type = 'violation.detected'").select(F.col("event_id").alias("alert_id"), "entity_id")
    step = lambda n, action, user, note, at: alerts.where(F.col("alert_id") % n == 0).select(
        "alert_id", F.lit(action).alias("action"), F.lit(user).alias("user"), F.lit(note).alias("note"), F.lit(at).alias("at")
    )
    updates = step(2, "acknowledge", "first", None, 1).union(step(3, "resolve", "second", "done", 2)).union(step(5, "suppress", "third", None, 3))
    return monitor.alert_states(alerts, updates)


@query(
    oracle(
        """select kind, value, count(a)::bigint as n from (select 'status' as kind, unnest(['open', 'acknowledged', 'resolved', 'suppressed']) as value
             union all select 'severity', unnest(['low', 'medium', 'high', 'critical'])) k left join (
               select event_id as a, 'status' as kind, case when event_id % 5 = 0 then 'suppressed' when event_id % 3 = 0 then 'resolved' when event_id % 2 = 0 then 'acknowledged' else 'open' end as value
               from compliance_events where event_type = 'violation.detected'
               union all select event_id, 'severity', 'critical' from compliance_events where event_type = 'violation.detected') using (kind, value) group by kind, value"""
    )
)
def a27_alert_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts by status and by severity, 0 where there are none."""
    rows = _alert_states(spark, sf_dir).withColumn("severity", F.lit(monitor.RULES["violation"]))
    return monitor.alert_totals(rows)


@query(
    oracle(
        f"""select {TOPIC_SQL} as topic, count(*)::bigint as messages, count(distinct entity_id)::bigint as keys, max(event_id) as last_event from compliance_events group by 1"""
    )
)
def t11_topic_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monitor.routed(domain.events(spark, sf_dir))
    return rows.groupBy("topic").agg(F.count("*").alias("messages"), F.countDistinct("key").alias("keys"), F.max("event_id").alias("last_event"))


@query("select 'us_federal_rules' as id, 'federal_register' as source, 'US' as jurisdiction union all select 'never', 'eurlex', 'EU'")
def t15_due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the default jobs and some more: those to be run at a given time."""
    rows = [(*j[:3], j[4], True) for j in changes.DEFAULT_JOBS] + [("never", "eurlex", "EU", 24, True), ("off", "eurlex", "EU", 24, False)]
    jobs = spark.createDataFrame(rows, "id string, source string, jurisdiction string, hours int, enabled boolean")
    runs = spark.createDataFrame(
        [("us_federal_rules", "2024-01-01 00:00:00"), ("us_federal_rules", "2024-01-02 11:59:00"), ("eu_regulations", "2024-01-02 12:01:00")], "id string, at string"
    ).withColumn("at", F.col("at").cast("timestamp_ntz"))
    return changes.due_jobs(jobs, runs, F.lit("2024-01-03 12:00:00").cast("timestamp_ntz")).select("id", "source", "jurisdiction")


@query(
    oracle(
        """select period, entity_id, count(*)::bigint as n, sum(score)::bigint as total, min(score) as least, max(score) as most, round(sum(score)::double / count(*), 6) as mean
           from compliance_events, (select unnest(['1h', '6h', '24h', '7d', '30d']) as period, unnest([1, 6, 24, 168, 720]) as hours)
           where ts >= timestamp '2024-01-29' - to_hours(hours::int) and ts < timestamp '2024-01-29' group by period, entity_id"""
    )
)
def a24_looking_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each entity over the hours and days before a time, all periods in one pass."""
    return monitor.looking_back(domain.events(spark, sf_dir), F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"))


@query(
    oracle(
        """select count(distinct entity_id)::bigint as active_entities, (select count(*) from entities)::bigint as total_entities, round(avg(score), 6) as mean_score,
             count(*) filter (where score >= 9500)::bigint as tier_1, count(*) filter (where score between 8500 and 9499)::bigint as tier_2,
             count(*) filter (where score between 7000 and 8499)::bigint as tier_3, count(*) filter (where score between 5000 and 6999)::bigint as tier_4,
             count(*) filter (where score < 5000)::bigint as tier_5, count(*) filter (where event_type = 'assessment.completed' and ts >= timestamp '2024-01-28')::bigint as assessments_24h,
             count(*) filter (where event_type = 'violation.detected' and ts >= timestamp '2024-01-28')::bigint as violations_24h from compliance_events where ts < timestamp '2024-01-29'"""
    )
)
def a25_system_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")
    return monitor.system_metrics(domain.events(spark, sf_dir).where(F.col("ts") < as_of), domain.entities(spark, sf_dir), as_of)


@query(SERIES_SQL)
def t07_metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.metric_series(domain.events(spark, sf_dir), "1 day")


@query(None)
def t07_metric_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same series from a stream over the files; windows that the watermark has not passed are still open and not in it."""
    run = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    raw = domain.table(spark, sf_dir, "events")
    source = spark.readStream.schema(raw.schema).parquet(f"{sf_dir}/events*.parquet")
    series = monitor.metric_series(domain.shaped_events(source), "1 day")
    monitor.drained(series, f"{run}/out", f"{run}/state")
    return spark.read.schema(series.schema).parquet(f"{run}/out")


@query(
    oracle(
        """select entity_id, event_type, n, last_event from (select entity_id, event_type, count(*)::bigint as n, max(event_id) as last_event
           from compliance_events group by 1, 2) where n >= 2"""
    )
)
def t08_entity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.events(spark, sf_dir).groupBy("entity_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event")).where("n >= 2")


@query(
    oracle(
        """select event_id, entity_id, score, previous, case when previous - score > 1000 then 'score_drop' else 'none' end as alert from (
           select event_id, entity_id, score, lag(score) over (partition by entity_id order by ts, event_id) as previous
           from compliance_events where event_type = 'score.calculated')"""
    )
)
def w12_score_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = domain.events(spark, sf_dir).where("event_type = 'score.calculated'").select("event_id", "entity_id", "ts", "score")
    rows = with_previous(scores, ["entity_id"], ["ts", "event_id"], {"previous": "score"}).drop("ts", "_turn")
    return rows.withColumn("alert", F.when(F.col("previous") - F.col("score") > 1000, "score_drop").otherwise("none"))


@query(None)
def t09_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.alerts(domain.events(spark, sf_dir), drop=1000, minutes=60)


@query(None)
def t06_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.limited(domain.events(spark, sf_dir), per_window=3, seconds=86400)


@query(
    oracle(
        """select entity_id, count(*) filter (where event_type = 'violation.detected')::bigint as violations,
             max_by(score, ts) as last_score, round(avg(score), 6) as mean_score,
             case when round(avg(score) filter (where ts >= timestamp '2024-01-15'), 6) > round(avg(score) filter (where ts < timestamp '2024-01-15'), 6)
               then 'up' else 'down' end as trend from compliance_events group by entity_id"""
    )
)
def a26_entity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp")
    mean = lambda c: F.round(F.avg(F.when(c, F.col("score"))), 6)
    return domain.events(spark, sf_dir).groupBy("entity_id").agg(
        F.count(F.when(F.col("event_type") == "violation.detected", 1)).alias("violations"), F.max_by("score", "ts").alias("last_score"),
        F.round(F.avg("score"), 6).alias("mean_score"), F.when(mean(late) > mean(~late), "up").otherwise("down").alias("trend"),
    )


@query(oracle("select entity_id, event_id, score from compliance_events where event_type = 'score.calculated' order by score desc, event_id limit 25"))
def o04_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.events(spark, sf_dir).where("event_type = 'score.calculated'").select("entity_id", "event_id", "score").orderBy(F.desc("score"), "event_id").limit(25)


@query(
    oracle(
        """select event_id, entity_id, sha256(event_id || ':' || event_type) as data_hash,
             lag(sha256(event_id || ':' || event_type)) over (partition by entity_id order by ts, event_id) as previous_hash from compliance_events"""
    )
)
def w07_audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.concat_ws(":", F.col("event_id").cast("string"), "event_type"), 256)
    rows = domain.events(spark, sf_dir).select("event_id", "entity_id", "ts", digest.alias("data_hash"))
    return with_previous(rows, ["entity_id"], ["ts", "event_id"], {"previous_hash": "data_hash"}).drop("ts", "_turn")


@query(
    oracle(
        """select entity_id, max_by(score, (ts, event_id)) as commitment, max(ts) as verified_at,
             max(ts) >= timestamp '2024-01-20' as current from compliance_events where event_type = 'assessment.completed' group by entity_id"""
    )
)
def w09_latest_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.events(spark, sf_dir).where("event_type = 'assessment.completed'")
    return rows.groupBy("entity_id").agg(
        F.max_by("score", F.struct("ts", "event_id")).alias("commitment"), F.max("ts").alias("verified_at"),
        (F.max("ts") >= F.lit("2024-01-20").cast("timestamp")).alias("current"),
    )


@query(
    oracle(
        """select event_id, k from (select event_id, regexp_extract(props, '"k": ([0-9]+)', 1)::int as k,
             row_number() over (partition by regexp_extract(props, '"k": ([0-9]+)', 1) order by ts, event_id) as n from compliance_events) where n = 1"""
    )
)
def w10_first_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.events(spark, sf_dir).select("event_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("k"))
    # The first of a key is a minimum, combined before the shuffle.
    return rows.groupBy("k").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select("event_id", "k")


@query(
    oracle(
        f"""select entity_id, current, previous, case when previous > 0 then {ratio_sql("(current - previous) * 100", "previous", 2)} end as change_percent from (
             select entity_id, sum(case when ts >= timestamp '2024-01-15' then 1 else 0 end)::bigint as current,
               sum(case when ts < timestamp '2024-01-15' then 1 else 0 end)::bigint as previous from compliance_events group by entity_id)"""
    )
)
def w11_period_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp")
    counts = domain.events(spark, sf_dir).groupBy("entity_id").agg(F.count(F.when(late, 1)).alias("current"), F.count(F.when(~late, 1)).alias("previous"))
    change = ratio((F.col("current") - F.col("previous")) * 100, F.col("previous"), 2)
    return counts.withColumn("change_percent", F.when(F.col("previous") > 0, change))


@query(
    oracle(
        """select b.band, coalesce(n, 0)::bigint as n from (select unnest([1, 2, 3, 4, 5]) as band) b left join (
           select case when score >= 9500 then 1 when score >= 8500 then 2 when score >= 7000 then 3 when score >= 5000 then 4 else 5 end as band,
             count(*) as n from compliance_events group by 1) c on b.band = c.band"""
    )
)
def a25_score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regatta.operators.scoring import zk_tier

    bands = spark.range(1, 6).select(F.col("id").cast("int").alias("band"))
    counts = domain.events(spark, sf_dir).groupBy(zk_tier(F.col("score")).alias("band")).agg(F.count("*").alias("n"))
    return bands.join(counts, "band", "left").fillna(0, ["n"])


