"""Queries on filters, search, statistics, writes, publishing and ingestion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.operators import catalog, graph, ingestion, mutations, rml, selection
from regatta.operators.storage import shared_dir
from regatta.plans.domain_sql import oracle
from regatta.plans.registry import query
from regatta.sources import domain, sinks
from regatta.streaming import changes, monitor


@query(
    oracle(
        """select requirement_id from requirements where tier in ('basic', 'standard') and method in ('SMALL', 'LARGE', 'PROMO')
             and list_has_any(jurisdictions, ['NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5']) and list_has_any(sectors, ['BUILDING', 'FURNITURE', 'ALL'])
             and layer in (1, 2, 3, 4, 5) and regulation_id in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7')
             and effective_date >= date '2020-06-01' and effective_date <= date '2024-06-01'"""
    )
)
def p01_all_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.filtered(
        domain.requirements(spark, sf_dir), tiers=["basic", "standard"], methods=["SMALL", "LARGE", "PROMO"], jurisdictions=[f"NATION_{i}" for i in range(1, 6)],
        sectors=["BUILDING", "FURNITURE", "ALL"], layers=[1, 2, 3, 4, 5], regulations=[f"Brand#{i}" for i in range(1, 8)],
        effective_after="2020-06-01", effective_before="2024-06-01",
    )
    return found.select("requirement_id")


@query(oracle("select regulation_id, name from regulations where jurisdiction = 'NATION_1' or list_contains(jurisdictions, 'NATION_1')"))
def p09_regulations_of_jurisdiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.in_jurisdiction(domain.regulations(spark, sf_dir), "nation_1").select("regulation_id", "name")


@query(
    """select doc_id, substr(text, 1, 200) as snippet, substr(text, 1, 500) as excerpt, substr(text, 1, 1000) as summary from documents"""
)
def p18_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda n, name: F.substring("text", 1, n).alias(name)
    return domain.table(spark, sf_dir, "documents").select("doc_id", cut(200, "snippet"), cut(500, "excerpt"), cut(1000, "summary"))


@query(
    oracle(
        """select s.requirement_id, round(s.score, 6) as score from (
             select requirement_id, sum(ln(1 + (docs - d + 0.5) / (d + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean))) as score from (
               select requirement_id, word, count(*)::double as n, any_value(length)::double as length from (
                 select requirement_id, length, unnest(tokens) as word from (select requirement_id, tokens, len(tokens) as length from (
                   select requirement_id, list_filter(regexp_split_to_array(lower(natural_language), '\\W+'), lambda t: t <> '') as tokens from requirements)))
               where word in ('red', 'ring') group by 1, 2) hit
             join (select word, count(distinct requirement_id)::double as d from (select requirement_id, unnest(regexp_split_to_array(lower(natural_language), '\\W+')) as word from requirements)
               where word in ('red', 'ring') group by 1) held using (word)
             cross join (select count(*)::double as docs, avg(len(list_filter(regexp_split_to_array(lower(natural_language), '\\W+'), lambda t: t <> ''))) as mean from requirements)
             group by requirement_id) s"""
    )
)
def f18_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.relevance(domain.requirements(spark, sf_dir), "Red ring", "requirement_id", "natural_language")
    return found.select("requirement_id", F.round("score", 6).alias("score"))


@query(
    oracle(
        """select requirement_id from requirements where contains(lower(natural_language), 'red') or contains(lower(natural_language), 'ring')
           order by (regexp_matches(lower(natural_language), '\\bred\\b'))::int + (regexp_matches(lower(natural_language), '\\bring\\b'))::int desc, requirement_id limit 25"""
    )
)
def o08_best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best matches of a search, by how many of its words they hold, then id."""
    words = F.split(F.lower("natural_language"), r"\W+")
    hits = sum((F.array_contains(words, w).cast("int") for w in ("red", "ring")), F.lit(0))
    return domain.requirements(spark, sf_dir).withColumn("_hits", hits).where("_hits > 0").orderBy(F.desc("_hits"), "requirement_id").limit(25).select("requirement_id")


STATISTICS = """statistics as (select regulation_id, 'tier' as field, tier as value, count(*)::bigint as n from requirements group by 1, 3
  union all select regulation_id, 'type', case when layer <= 3 then 'obligation' else 'prohibition' end, count(*) from requirements group by 1, 3
  union all select regulation_id, 'method', method, count(*) from requirements group by 1, 3
  union all select regulation_id, 'total', 'total', count(*) from requirements group by 1)"""


@query(oracle("select regulation_id, field, value, n from statistics", STATISTICS))
def a18_regulation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("layer") <= 3, "obligation").otherwise("prohibition")
    return catalog.regulation_statistics(domain.requirements(spark, sf_dir).select("regulation_id", "tier", "method", kind.alias("type")))


@query(
    oracle(
        """select r.regulation_id, upper(max(g.jurisdiction)) as jurisdiction, count(*)::bigint as total_requirements, count(*) filter (where tier = 'basic')::bigint as basic,
             count(*) filter (where tier = 'standard')::bigint as standard, count(*) filter (where tier = 'advanced')::bigint as advanced
           from requirements r left join regulations g on r.regulation_id = g.regulation_id group by 1"""
    )
)
def a19_pipeline_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run of the pipeline found for each regulation: its place and requirements by tier."""
    of = lambda t: F.count(F.when(F.col("tier") == t, 1)).alias(t)
    counts = domain.requirements(spark, sf_dir).groupBy("regulation_id").agg(F.count("*").alias("total_requirements"), *map(of, rml.TIERS))
    places = domain.regulations(spark, sf_dir).select("regulation_id", F.upper("jurisdiction").alias("jurisdiction"))
    return counts.join(places, "regulation_id", "left").select("regulation_id", "jurisdiction", "total_requirements", *rml.TIERS)


@query(oracle("select tier, count(*)::bigint as n from requirements where list_contains(jurisdictions, 'NATION_1') group by tier"))
def a13_count_by_tier_in_jurisdiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.filtered(domain.requirements(spark, sf_dir), jurisdictions=["NATION_1"]).groupBy("tier").agg(F.count("*").alias("n"))


@query(
    oracle(
        """select event_type, p, (list(score order by score))[(floor(count(*) * p / 100) + 1)::int] as percentile, count(*)::bigint as n, min(score) as least, max(score) as most
           from compliance_events, (select unnest([50, 95, 99]) as p) group by event_type, p"""
    )
)
def a28_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of the scores of each type of event."""
    return selection.percentiles(domain.events(spark, sf_dir), "event_type", "score", (50, 95, 99))


@query(
    oracle(
        """select requirement_id, unnest(list_distinct(list_concat(coalesce(g.jurisdictions, []), coalesce(r.jurisdictions, [])))) as jurisdiction
           from requirements r left join regulations g on r.regulation_id = g.regulation_id"""
    )
)
def u03_united_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jurisdictions of each requirement and of its regulation together, each once."""
    none = F.array().cast("array<string>")
    own = domain.requirements(spark, sf_dir).select("requirement_id", "regulation_id", F.coalesce("jurisdictions", none).alias("_r"))
    met = own.join(domain.regulations(spark, sf_dir).select("regulation_id", "jurisdictions"), "regulation_id", "left")
    return met.select("requirement_id", F.explode(F.array_union(F.coalesce("jurisdictions", none), "_r")).alias("jurisdiction"))


@query(
    oracle(
        """select entity_id, assessment_id, completed_at from (select *, row_number() over (partition by entity_id order by completed_at desc, assessment_id desc) as n
           from assessments where status = 'completed') where n <= 3"""
    )
)
def o05_latest_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest completed assessments of each entity."""
    done = domain.assessments(spark, sf_dir).where("status = 'completed'").select("entity_id", "assessment_id", "completed_at")
    return catalog.latest(done, ["completed_at", "assessment_id"], 3, per="entity_id")


@query(oracle("select event_id, entity_id, ts from compliance_events order by ts desc, event_id desc limit 100"))
def o05_latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest(domain.events(spark, sf_dir).select("event_id", "entity_id", "ts"), ["ts", "event_id"], 100)


@query(
    oracle(
        """select entity_id, max(score) as score from compliance_events e join entities using (entity_id) where event_type = 'score.calculated'
             and list_contains(sectors, 'BUILDING') and list_contains(jurisdictions, 'ASIA') group by entity_id order by score desc, entity_id limit 20"""
    )
)
def o04_leaderboard_of_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of one sector and region by their best score."""
    own = domain.entities(spark, sf_dir).where(F.array_contains("sectors", "BUILDING") & F.array_contains("jurisdictions", "ASIA")).select("entity_id")
    best = domain.events(spark, sf_dir).where("event_type = 'score.calculated'").join(own, "entity_id").groupBy("entity_id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "entity_id").limit(20)


@query(oracle("select tier, count(*)::bigint as n from requirements where layer <= 4 group by tier"))
def s02_named_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read with named parameters over the tables of the graph."""
    return catalog.ad_hoc(spark, {"need": domain.requirements(spark, sf_dir)}, "select tier, count(*) as n from need where layer <= :most group by tier", {"most": 4})


@query(
    oracle(
        """select r.regulation_id, count(distinct s.entity_id)::bigint as entities from requirements r join states s on r.requirement_id = s.requirement_id
           where r.tier = 'advanced' group by 1 having count(distinct s.entity_id) > 5"""
    )
)
def g13_ad_hoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"need": domain.requirements(spark, sf_dir), "rated": domain.states(spark, sf_dir)}
    sql = """with top as (select * from need where tier = :tier) select t.regulation_id, count(distinct s.entity_id) as entities
             from top t join rated s on t.requirement_id = s.requirement_id group by t.regulation_id having count(distinct s.entity_id) > :least"""
    return catalog.ad_hoc(spark, tables, sql, {"tier": "advanced", "least": 5})


CHANGED = """(select entity_id, requirement_id, case when requirement_id % 2 = 0 then 'exempt' else status end as status from states where entity_id % 3 = 0
    union all select entity_id, 1000000 + entity_id, 'pending' from entities)"""


def _changed_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = domain.states(spark, sf_dir).select("entity_id", "requirement_id", "status")
    status = F.when(F.col("requirement_id") % 2 == 0, "exempt").otherwise(F.col("status"))
    again = base.where("entity_id % 3 = 0").select("entity_id", "requirement_id", status.alias("status"))
    new = domain.entities(spark, sf_dir).select("entity_id", (F.col("entity_id") + 1000000).alias("requirement_id"), F.lit("pending").alias("status"))
    return base, again.union(new)


@query(
    oracle(
        f"""select count(*) filter (where s.entity_id is null)::bigint as created, count(*) filter (where s.status <> c.status)::bigint as updated,
              count(*) filter (where s.status = c.status)::bigint as unchanged, count(*) filter (where c.entity_id is null)::bigint as untouched
            from states s full outer join {CHANGED} c on s.entity_id = c.entity_id and s.requirement_id = c.requirement_id"""
    )
)
def s03_write_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merge of states creates, updates and leaves."""
    return mutations.merged(*_changed_states(spark, sf_dir), ["entity_id", "requirement_id"])[1]


@query(
    oracle(
        f"""select coalesce(c.entity_id, s.entity_id) as entity_id, coalesce(c.requirement_id, s.requirement_id) as requirement_id, coalesce(c.status, s.status) as status,
              'CS-' || coalesce(c.entity_id, s.entity_id) || '-' || coalesce(c.requirement_id, s.requirement_id) as state_id
            from states s full outer join {CHANGED} c on s.entity_id = c.entity_id and s.requirement_id = c.requirement_id"""
    )
)
def g10_merged_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = mutations.merged(*_changed_states(spark, sf_dir), ["entity_id", "requirement_id"])[0]
    return merged.withColumn("state_id", F.concat_ws("-", F.lit("CS"), F.col("entity_id").cast("string"), F.col("requirement_id").cast("string")))


@query(
    oracle(
        """select src::varchar as src, dst::varchar as dst, 'CONFLICTS_WITH' as type, case when src % 26 = 0 then 'direct' else 'marked' end as kind from conflicts where dst % 3 <> 0
           union all select requirement_id::varchar, (requirement_id + 2)::varchar, 'CONFLICTS_WITH', 'marked' from requirements where requirement_id % 100 = 99
             and requirement_id % 13 <> 0"""
    )
)
def g10_marked_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts after some were marked (again or anew) and some taken away, these in either direction."""
    known = domain.conflicts(spark, sf_dir).withColumn("kind", F.lit("direct"))
    edges = graph.relationships(known, "src", "dst", "CONFLICTS_WITH", kind="kind")
    again = domain.conflicts(spark, sf_dir).where("src % 26 <> 0").withColumn("kind", F.lit("marked"))
    new = domain.requirements(spark, sf_dir).where("requirement_id % 100 = 99 and requirement_id % 13 <> 0")
    new = new.select(F.col("requirement_id").alias("src"), (F.col("requirement_id") + 2).alias("dst"), F.lit("marked").alias("kind"))
    marked = graph.with_edges(edges, graph.relationships(again.union(new), "src", "dst", "CONFLICTS_WITH", kind="kind"))
    lost = domain.conflicts(spark, sf_dir).where("dst % 3 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    left = graph.without_edges(marked, graph.relationships(lost, "src", "dst", "CONFLICTS_WITH"), directed=False)
    return left.select("src", "dst", "type", F.col("props")["kind"].alias("kind"))


@query(
    oracle(
        """select 'Requirement' as type, requirement_id::varchar as id, natural_language as name from requirements
           union all select distinct 'Regulation', r.regulation_id, coalesce(g.name, r.regulation_id) from requirements r left join regulations g on r.regulation_id = g.regulation_id
           union all select distinct 'Jurisdiction', j, j from (select unnest(jurisdictions) as j from requirements)
           union all select distinct 'Sector', s, case s when 'ALL' then 'All Sectors' else s end from (select unnest(sectors) as s from requirements)"""
    )
)
def n20_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rml.graph_nodes(domain.requirements(spark, sf_dir), domain.regulations(spark, sf_dir))


BROKEN = "requirement_id % 9 = 0"
UNNAMED = "requirement_id % 11 = 0"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per requirement as JSON text: some cut short, some without a name, some with a tier that does not exist."""
    k = F.col("requirement_id")
    item = F.struct(
        k.cast("string").alias("id"), F.lit("Art. 1").alias("article_ref"), F.col("natural_language").alias("text"),
        F.when(k % 13 == 0, "gold").otherwise(F.col("tier")).alias("tier"),
    )
    name = F.when(k % 11 != 0, F.concat(F.lit("Document "), k.cast("string")))
    day = F.when(k % 17 == 0, "soon").otherwise(F.col("effective_date").cast("string"))
    doc = F.to_json(F.struct(k.cast("string").alias("id"), name.alias("name"), F.lit("NATION_1").alias("jurisdiction"), day.alias("effective_date"), F.array(item, item).alias("requirements")))
    return domain.requirements(spark, sf_dir).select(k.alias("doc_id"), F.when(k % 9 == 0, F.substring(doc, 1, 30)).otherwise(doc).alias("json"))


INGESTED = f"""ingested as (select requirement_id as doc_id, case when {BROKEN} then 'failed' else 'succeeded' end as status,
    case when {BROKEN} then 'not a document' end as error, case when {BROKEN} then 0 else 2 end::bigint as requirements,
    case when {BROKEN} then 0 else ({UNNAMED})::int + 2 * (requirement_id % 13 = 0)::int + (requirement_id % 17 = 0)::int end::bigint as warnings from requirements)"""


@query(oracle("select * from ingested", INGESTED))
def s16_batch_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every document of a batch; one that cannot be read fails by itself."""
    return ingestion.outcomes(_documents(spark, sf_dir))


@query(
    oracle(
        """select count(*)::bigint as processed, count(*) filter (where status = 'succeeded')::bigint as succeeded, count(*) filter (where status = 'failed')::bigint as failed,
             sum(requirements)::bigint as requirements, count(*) filter (where status = 'succeeded')::double / count(*) as success_rate from ingested""",
        INGESTED,
    )
)
def a20_ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingestion.totals(ingestion.outcomes(_documents(spark, sf_dir)))


@query(
    oracle(
        f"""select requirement_id as doc_id, unnest(list_filter([case when {UNNAMED} then 'Missing required field: name' end,
              case when requirement_id % 17 = 0 then 'Invalid effective_date format: soon' end,
              case when requirement_id % 13 = 0 then 'Requirement ' || requirement_id || ': Invalid tier ''gold''' end,
              case when requirement_id % 13 = 0 then 'Requirement ' || requirement_id || ': Invalid tier ''gold''' end], lambda e: e is not null)) as error
            from requirements where not ({BROKEN})"""
    )
)
def p12_document_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken rule of the documents of a batch."""
    return ingestion.errors(ingestion.parsed(_documents(spark, sf_dir)))


@query(oracle(f"select requirement_id as doc_id from requirements where not ({BROKEN}) and requirement_id in (3, 9, 10, 11, 500)"))
def s17_selected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents that have a body, restricted to given ids, as a synchronisation takes them."""
    docs = ingestion.parsed(_documents(spark, sf_dir))
    return docs.where(F.col("body").isNotNull() & F.col("doc_id").isin(3, 9, 10, 11, 500)).select("doc_id")


@query(
    oracle(
        """select 'entities' as name, count(*)::bigint as n, (count(*) - count(distinct entity_id))::bigint as repeated, count(*) filter (where entity_id is null)::bigint as missing from entities
           union all select 'requirements', count(*), count(*) - count(distinct requirement_id), count(*) filter (where requirement_id is null) from requirements
           union all select 'items', count(*), count(*) - count(distinct (assessment_id, line)), count(*) filter (where assessment_id is null or line is null) from items"""
    )
)
def s18_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, repeated keys and missing keys of tables whose keys should be unique."""
    tables = {"entities": (domain.entities, ["entity_id"]), "requirements": (domain.requirements, ["requirement_id"]), "items": (domain.items, ["assessment_id", "line"])}
    return ingestion.uniqueness({name: (f(spark, sf_dir), key) for name, (f, key) in tables.items()})


@query(
    oracle(
        """select cast(ts as date) as day, event_type, count(*)::bigint as n from compliance_events where cast(ts as date) between date '2024-01-08' and date '2024-01-14' group by 1, 2"""
    )
)
def s19_dated_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written to a table by day, and one week read back from its folders alone."""
    path = f"{shared_dir(spark)}/metrics-{uuid.uuid4().hex}"
    rows = domain.events(spark, sf_dir).select("event_id", "event_type", "ts")
    sinks.write_dated(rows, path)
    week = sinks.read_dated(spark, path, "event_id bigint, event_type string, ts timestamp_ntz", "2024-01-08", "2024-01-14")
    return week.groupBy("day", "event_type").agg(F.count("*").alias("n"))


TOPIC_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in monitor.TOPICS.items()) + f" else '{monitor.DEFAULT_TOPIC}' end"


@query(oracle(f"select {TOPIC_SQL} as topic, count(*)::bigint as sent from compliance_events group by 1"))
def s07_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of events written to a folder per topic, and what was sent to each."""
    sink = sinks.Sink("json", {"path": f"{shared_dir(spark)}/topics-{uuid.uuid4().hex}"})
    return sinks.published(monitor.routed(domain.events(spark, sf_dir)), sink)


@query(None)
def s08_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published events read back as a stream of a few files a batch, from the beginning to what there is now."""
    run = f"{shared_dir(spark)}/consumer-{uuid.uuid4().hex}"
    sinks.Sink("json", {"path": f"{run}/topics"}).write(monitor.routed(domain.events(spark, sf_dir)))
    schema = "key string, value string, topic string"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).json(f"{run}/topics")
    monitor.drained(source, f"{run}/out", f"{run}/state")
    return spark.read.schema(schema).parquet(f"{run}/out").groupBy("topic").agg(F.count("*").alias("received"))


@query(
    oracle(
        """select 'score:' || entity_id as key, last as value from (select entity_id, max_by(score, (ts, event_id)) as last, max(ts) as seen from compliance_events group by entity_id)
           where seen + interval 3600 second > timestamp '2024-01-29 12:00:00' and not regexp_matches('score:' || entity_id, '^score:1.*$')"""
    )
)
def s09_cached_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached latest scores that have not expired at a given time, after the keys of a pattern were dropped."""
    last = domain.events(spark, sf_dir).groupBy("entity_id").agg(F.max_by("score", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("at"))
    entries = last.select(F.concat(F.lit("score:"), F.col("entity_id").cast("string")).alias("key"), "value", "at")
    cache = sinks.with_expiry(entries, F.col("at"), 3600)
    live = sinks.unexpired(cache, F.lit("2024-01-29 12:00:00").cast("timestamp_ntz"))
    return sinks.without_keys(live, "score:1*").select("key", "value")


@query(None)
def s13_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of any format as one table; here one data file, which is none of the text formats."""
    return sinks.documents_in(spark, f"{sf_dir}/region.parquet").select("path", "length", "format")


@query(
    oracle(
        """select assessment_id, case when action = 'start' and status = 'draft' then 'in_progress' when action = 'submit' and status = 'in_progress' then 'pending_review'
               when action = 'approve' and status = 'pending_review' then 'completed' when action = 'reject' and status = 'pending_review' then 'rejected'
               when action = 'reopen' and status = 'rejected' then 'in_progress' when action = 'archive' and status = 'completed' then 'archived' end as next_status,
             status, action from (select assessment_id, ['draft', 'in_progress', 'pending_review', 'rejected', 'completed', 'archived'][(assessment_id % 6 + 1)::int] as status,
               ['start', 'submit', 'approve', 'reject', 'reopen', 'archive'][(assessment_id // 6 % 6 + 1)::int] as action from assessments)"""
    )
)
def p11_all_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action in every state."""
    pick = lambda items, i: F.element_at(F.array(*map(F.lit, items)), (i % len(items) + 1).cast("int"))
    k = F.col("assessment_id")
    states = ("draft", "in_progress", "pending_review", "rejected", "completed", "archived")
    rows = domain.assessments(spark, sf_dir).select("assessment_id", pick(states, k).alias("status"))
    actions = rows.select("assessment_id", pick(("start", "submit", "approve", "reject", "reopen", "archive"), F.floor(k / 6)).alias("action"))
    return mutations.transitioned(rows, actions).select("assessment_id", "next_status", "status", "action")


@query(
    oracle(
        """select assessment_id, case when s = 'draft' and a = 'start' then 'in_progress' when s = 'in_progress' and a = 'submit' then 'pending_review'
             when s = 'pending_review' and a = 'approve' then 'completed' when s = 'pending_review' and a = 'reject' then 'rejected'
             when s = 'rejected' and a = 'reopen' then 'in_progress' when s = 'completed' and a = 'archive' then 'archived' else s end as status,
             case when s = 'draft' and a = 'start' then timestamp '2024-02-01' end as started_at,
             case when s = 'pending_review' and a = 'approve' then timestamp '2024-02-01' end as completed_at,
             case when s = 'pending_review' and a = 'approve' then 'user ' || assessment_id end as approver,
             case when s = 'pending_review' and a = 'reject' then 'user ' || assessment_id end as reviewer
           from (select assessment_id, ['draft', 'in_progress', 'pending_review', 'rejected', 'completed', 'archived'][(assessment_id % 6 + 1)::int] as s,
             ['start', 'submit', 'approve', 'reject', 'reopen', 'archive'][(assessment_id // 6 % 6 + 1)::int] as a from assessments)"""
    )
)
def d05_transition_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p11_all_transitions(spark, sf_dir)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    base = rows.select(
        "assessment_id", "status", none("timestamp_ntz", "started_at"), none("timestamp_ntz", "completed_at"), none("string", "approver"), none("string", "reviewer"),
        none("timestamp_ntz", "updated_at"),
    )
    actions = rows.select("assessment_id", "action", F.concat(F.lit("user "), F.col("assessment_id").cast("string")).alias("user"))
    return mutations.transition_effects(base, actions, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).drop("updated_at")


@query(
    oracle(
        """select entity_id, case when entity_id % 10 = 0 then 'advanced' else 'basic' end as tier, entity_id % 10 = 0 as tier_override,
             case when entity_id % 10 = 0 then 'by hand' end as reason from entities"""
    )
)
def d06_tier_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers set by hand, some of them cleared later."""
    own = domain.entities(spark, sf_dir).select("entity_id", F.lit("basic").alias("tier"))
    first = own.where("entity_id % 5 = 0").select("entity_id", F.lit("advanced").alias("tier"), F.lit("by hand").alias("reason"), F.lit(1).alias("at"))
    cleared = own.where("entity_id % 10 = 5").select("entity_id", F.lit(None).cast("string").alias("tier"), F.lit(None).cast("string").alias("reason"), F.lit(2).alias("at"))
    return mutations.with_overrides(own, first.union(cleared))


@query(
    oracle(
        """select entity_id, 'overall' as score_type, max(score)::bigint as score, null::varchar as note from compliance_events group by entity_id
           union all select entity_id, 'risk', 0, 'initial' from entities where entity_id % 2 = 0"""
    )
)
def d01_score_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score table after new rows were added, which lack a column of it."""
    base = domain.entities(spark, sf_dir).where("entity_id % 2 = 0").select("entity_id", F.lit("risk").alias("score_type"), F.lit(0).cast("bigint").alias("score"), F.lit("initial").alias("note"))
    new = domain.events(spark, sf_dir).groupBy("entity_id").agg(F.lit("overall").alias("score_type"), F.max("score").cast("bigint").alias("score"))
    return mutations.inserted(base, new)


@query(oracle("select entity_id, case when entity_id % 50 = 0 then timestamp '2024-01-01' when entity_id % 7 = 0 then timestamp '2024-02-02' end as deleted_at from entities"))
def d04_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities after more of them were deleted; what was deleted before keeps its time."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    rows = domain.entities(spark, sf_dir).select("entity_id", F.when(F.col("deleted"), at("2024-01-01 00:00:00")).alias("deleted_at"))
    return mutations.soft_deleted(rows, F.col("entity_id") % 7 == 0, at("2024-02-02 00:00:00"))


VERSIONS = """old_needs as (select requirement_id, regulation_id, natural_language as text from requirements where requirement_id % 10 <> 4),
  new_needs as (select requirement_id, regulation_id, case when requirement_id % 7 = 0 then natural_language || ' subject to a penalty'
      when requirement_id % 7 = 1 then natural_language || ' and more words here' else natural_language end as text from requirements where requirement_id % 10 <> 3),
  old_regs as (select regulation_id, name, effective_date from regulations where regulation_id <> 'Draft'),
  new_regs as (select regulation_id, case when regulation_id = 'Brand#3' then name || ' (recast)' else name end as name,
      case when regulation_id = 'Brand#5' then date '2030-01-01' else effective_date end as effective_date from regulations),
  met as (select coalesce(n.regulation_id, o.regulation_id) as regulation_id, o.requirement_id as a, n.requirement_id as b, o.text as old_text, n.text as new_text
    from old_needs o full outer join new_needs n on o.requirement_id = n.requirement_id
    where coalesce(n.regulation_id, o.regulation_id) in (select regulation_id from old_regs) and o.text is distinct from n.text),
  changes as (select regulation_id, coalesce(a, b) as requirement_id, case when a is null then 'new' when b is null then 'deleted' else 'modified' end as change_type,
      case when a is null then 'high' when b is null then 'medium' when contains(new_text, 'penalty') then 'critical' else 'high' end as severity,
      case when a is null then 'New' when b is null then 'Removed' else 'Modified' end || ' requirement: ' || coalesce(a, b) as summary, old_text as old_content, new_text as new_content from met
    union all select regulation_id, null, 'new', 'high', 'New regulation: ' || name, null, name from new_regs where regulation_id not in (select regulation_id from old_regs)
    union all select n.regulation_id, null, 'modified', 'low', 'Metadata change: name', o.name, n.name from new_regs n join old_regs o using (regulation_id) where o.name <> n.name
    union all select n.regulation_id, null, 'modified', 'low', 'Metadata change: effective_date', o.effective_date::varchar, n.effective_date::varchar
      from new_regs n join old_regs o using (regulation_id) where o.effective_date <> n.effective_date)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    need, regs = domain.requirements(spark, sf_dir), domain.regulations(spark, sf_dir)
    k, text = F.col("requirement_id"), F.col("natural_language")
    again = F.when(k % 7 == 0, F.concat(text, F.lit(" subject to a penalty"))).when(k % 7 == 1, F.concat(text, F.lit(" and more words here"))).otherwise(text)
    shape = lambda rows, t: rows.select("requirement_id", "regulation_id", k.cast("string").alias("article_ref"), t.alias("text"), F.lit("obligation").alias("type"))
    name = F.when(F.col("regulation_id") == "Brand#3", F.concat("name", F.lit(" (recast)"))).otherwise(F.col("name"))
    day = F.when(F.col("regulation_id") == "Brand#5", F.lit("2030-01-01").cast("date")).otherwise(F.col("effective_date"))
    return rml.regulation_changes(
        shape(need.where("requirement_id % 10 <> 4"), text), shape(need.where("requirement_id % 10 <> 3"), again),
        regs.where("regulation_id <> 'Draft'").select("regulation_id", "name", "effective_date"), regs.select("regulation_id", name.alias("name"), day.alias("effective_date")),
    )


@query(oracle("select regulation_id, requirement_id, change_type, severity, summary, old_content, new_content from changes", VERSIONS))
def n19_regulation_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@query(
    oracle(
        """select regulation_id as key, 'regulations.updates' as topic, '{"event_type":"regulatory_change","regulation_id":"' || regulation_id || '","change_type":"' || change_type ||
             '","severity":"' || severity || '","summary":"' || summary || '","detected_at":"2024-02-01T00:00:00"}' as value from changes""",
        VERSIONS,
    )
)
def t05_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.change_events(_changes(spark, sf_dir), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query(
    """select doc_id, coalesce(sha256(case when doc_id % 7 = 0 then text || ' penalty' else text end) <> sha256(text), false) and doc_id % 10 <> 0 as changed,
         case when doc_id % 10 <> 0 then sha256(case when doc_id % 7 = 0 then text || ' penalty' else text end) end as new_hash from documents"""
)
def t14_update_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which known documents changed; every tenth cannot be fetched and counts as unchanged."""
    docs = domain.table(spark, sf_dir, "documents").select("doc_id", "text")
    known = docs.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    again = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" penalty"))).otherwise(F.col("text"))
    return changes.update_checks(known, docs.where("doc_id % 10 <> 0").select("doc_id", F.sha2(again, 256).alias("content_hash")), "doc_id")


AD_HOC = {
    "select * from t offset 3": True, "with q as (select 1) select created_at from q": True, "drop table t": False,
    "with q as (select 1) insert into t select * from q": False, "select 'drop' as kept -- delete": True, "(select 1)": True, "update t set a = 1": False,
}


@query(f"select doc_id, doc_id % 7 not in ({', '.join(str(i) for i, reads in enumerate(AD_HOC.values()) if not reads)}) as reads from documents")
def p15_write_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ad-hoc texts only read."""
    text = F.element_at(F.array(*map(F.lit, AD_HOC)), (F.col("doc_id") % 7 + 1).cast("int"))
    return domain.table(spark, sf_dir, "documents").select("doc_id", catalog.reads_only(text).alias("reads"))
