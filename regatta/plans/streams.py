"""Queries on streams with state, the consume loop, and what is kept on disk: saved answers, the search index, embeddings, keyed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.operators.embedding import EmbeddingCache, embedded
from regatta.operators.search_index import SearchIndex
from regatta.operators.storage import shared_dir
from regatta.plans.domain_sql import oracle
from regatta.plans.registry import query
from regatta.plans.watching import MESSAGES, messages
from regatta.sources import domain, saved_answers
from regatta.sources.keyed_table import KeyedTable
from regatta.streaming import consume, monitor, ordered


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream over their files."""
    schema = domain.table(spark, sf_dir, "events").schema
    return domain.shaped_events(spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet"))


#: What the watermark has passed when a stream of all events ends: all but the last ten minutes.
PASSED = "us <= (select max(epoch_us(ts)) // 1000 * 1000 - 600000000 from compliance_events)"


@query(
    oracle(
        f"select event_id, entity_id, used <= 3 as allowed from windows where {PASSED}",
        "turns as (select event_id, entity_id, epoch_us(ts) as us, row_number() over (partition by entity_id order by ts, event_id) as n from compliance_events)",
        """windows(entity_id, n, event_id, us, opened, used) as (
             select entity_id, n, event_id, us, us, 1 from turns where n = 1
             union all
             select t.entity_id, t.n, t.event_id, t.us, case when t.us - w.opened < 86400000000 then w.opened else t.us end,
               case when t.us - w.opened < 86400000000 then w.used + 1 else 1 end
             from windows w join turns t on t.entity_id = w.entity_id and t.n = w.n + 1)""",
    )
)
def t06_rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests within three a day of their entity's window, from a stream with a timer that closes the window."""
    run = _folder(spark, "limited")
    found = ordered.limited(_event_stream(spark, sf_dir), per_window=3, seconds=86400)
    monitor.drained(found, f"{run}/out", f"{run}/state")
    return spark.read.schema(found.schema).parquet(f"{run}/out").drop("ts")


TIER_SQL = "case when {0} >= 9500 then 1 when {0} >= 8500 then 2 when {0} >= 7000 then 3 when {0} >= 5000 then 4 else 5 end"


@query(
    oracle(
        f"""select event_id, entity_id, rule, case rule when 'violation' then 'critical' else 'high' end as severity from fired where fires and {PASSED}""",
        """scored as (select event_id, entity_id, ts, score, lag(score) over (partition by entity_id order by ts, event_id) as before
             from compliance_events where event_type = 'score.calculated')""",
        f"""hits as (select event_id, entity_id, ts, 'violation' as rule from compliance_events where event_type = 'violation.detected'
             union all select event_id, entity_id, ts, 'score_drop' from scored where score - before < -1000
             union all select event_id, entity_id, ts, 'tier_downgrade' from scored where {TIER_SQL.format("score")} > {TIER_SQL.format("before")} and before is not null)""",
        "turns as (select event_id, entity_id, rule, epoch_us(ts) as us, row_number() over (partition by entity_id, rule order by ts, event_id) as n from hits)",
        """fired(entity_id, rule, n, event_id, us, last, fires) as (
             select entity_id, rule, n, event_id, us, us, true from turns where n = 1
             union all
             select t.entity_id, t.rule, t.n, t.event_id, t.us, case when t.us - f.last >= 3600000000 then t.us else f.last end, t.us - f.last >= 3600000000
             from fired f join turns t on t.entity_id = f.entity_id and t.rule = f.rule and t.n = f.n + 1)""",
    )
)
def t09_alerts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a stream of events, each rule muted for an hour after it fired for an entity."""
    run = _folder(spark, "alerts")
    found = ordered.alerts(_event_stream(spark, sf_dir), drop=1000, minutes=60)
    monitor.drained(found, f"{run}/out", f"{run}/state")
    return spark.read.schema(found.schema).parquet(f"{run}/out").drop("ts")


@query(
    oracle(
        """select event_id, case when event_id % 20 = 0 then 'not JSON' when event_id % 20 = 1 then 'missing event_type, entity_id' end as reason,
             case when event_id % 20 >= 2 then event_type end as event_type from (select * from messages join compliance_events using (event_id))""",
        MESSAGES,
    )
)
def t02_consume_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message handled or set apart, once each, over two runs of the loop: the first stops after its first batch."""
    run = _folder(spark, "consumed")
    rows = messages(spark, sf_dir)
    rows.repartition(6).write.parquet(f"{run}/topic")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{run}/topic")
    loop = consume.Loop(f"{run}/handled", f"{run}/rejected", "event_id bigint, event_type string, entity_id bigint", ("event_id", "event_type", "entity_id"))
    loop.run(stream, f"{run}/state", max_messages=1)
    loop.run(stream, f"{run}/state")
    good = spark.read.parquet(f"{run}/handled").select("event_id", F.lit(None).cast("string").alias("reason"), "event_type")
    return good.union(spark.read.parquet(f"{run}/rejected").select("event_id", "reason", F.lit(None).cast("string")))


@query(oracle("select 'routed_events' as name, count(*)::bigint as rows, 0::bigint as lag, false as failed from compliance_events"))
def t12_stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the record of a drained stream says: rows of all its batches, the last lag, and whether it failed."""
    run = _folder(spark, "recorded")
    with consume.recorded(spark, f"{run}/progress"):
        monitor.drained(monitor.routed(_event_stream(spark, sf_dir)), f"{run}/out", f"{run}/state", name="routed_events")
    told = spark.read.schema(consume.PROGRESS).parquet(f"{run}/progress")
    return told.groupBy("name").agg(F.sum("rows").alias("rows"), F.max_by("lag", "batch_id").alias("lag"), F.max("failed").alias("failed"))


FEDERAL_TYPES = ("RULE", "PRORULE", "NOTICE", "PRESDOCU", "CORRECT")


@query(
    """select 'FR-' || p_partkey as source_id, p_name as title, ['rule', 'proposed_rule', 'notice', 'executive_order', 'regulation'][(p_partkey % 5 + 1)::int] as document_type,
         date '2024-01-01' + (p_partkey % 300)::int as publication_date, case when p_partkey % 3 = 2 then date '2024-02-01' + (p_partkey % 300)::int end as effective_date,
         p_brand as agency, (p_partkey % 50 + 1) || ' CFR ' || (p_partkey % 7) || ';' || (p_partkey % 50 + 1) || ' CFR ' || (p_partkey % 11) as cfr,
         p_name || chr(10) || chr(10) || 'Part ' || p_partkey || ' & more.' as content,
         sha256(p_name || chr(10) || chr(10) || 'Part ' || p_partkey || ' & more.') as content_hash from part"""
)
def s10_federal_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of the Federal Register for each part, saved as the service answers and read by the data source."""
    k, folder = F.col("p_partkey"), _folder(spark, "answers")
    published = F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int"))
    effective = F.when(k % 3 == 1, "to be set").when(k % 3 == 2, F.date_add(published, 31).cast("string"))
    body = F.concat(F.lit("<h1>"), "p_name", F.lit("</h1><script>x</script><p>Part "), k.cast("string"), F.lit(" &amp; more.</p>"))
    answer = F.struct(
        F.concat(F.lit("FR-"), k.cast("string")).alias("document_number"), F.col("p_name").alias("title"),
        F.element_at(F.array(*map(F.lit, FEDERAL_TYPES)), (k % 5 + 1).cast("int")).alias("type"), published.cast("string").alias("publication_date"),
        effective.alias("effective_on"), F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.lit("").alias("name"))).alias("agencies"),
        F.array(F.struct((k % 50 + 1).alias("title"), F.array(k % 7, k % 11).alias("parts"))).alias("cfr_references"), body.alias("body_html"),
    )
    domain.table(spark, sf_dir, "part").select(F.to_json(answer)).write.text(f"{folder}/{saved_answers.FEDERAL}")
    documents = saved_answers.scraped(saved_answers.saved_answers(spark, folder).where(F.col("source") == saved_answers.FEDERAL))
    return documents.select(
        "source_id", "title", "document_type", "publication_date", "effective_date", "agency", F.array_join("cfr_references", ";").alias("cfr"), "content", "content_hash"
    )


@query(
    """select celex as source_id, case when page_id % 3 = 1 then 'directive' else 'regulation' end as document_type, 'EU' as jurisdiction,
         coalesce(nullif(trim(regexp_extract(html, '<title>([^<]+)</title>', 1)), ''), 'EUR-Lex Document ' || celex) as title,
         nullif(regexp_extract(html, 'eli/[^"''>[:space:]]+', 0), '') as eli,
         try_cast(nullif(regexp_extract(substr(html, 1, 5000), '[0-9]{4}-[0-9]{2}-[0-9]{2}', 0), '') as date) as publication_date
       from (select *, '3' || (2000 + page_id % 25) || ['R', 'L', 'D'][(page_id % 3 + 1)::int] || lpad((page_id % 10000)::varchar, 4, '0') as celex from pages)"""
)
def s11_eurlex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page saved as EUR-Lex answers it, and read by the data source."""
    k, folder = F.col("page_id"), _folder(spark, "answers")
    letter = F.element_at(F.array(*map(F.lit, "RLD")), (k % 3 + 1).cast("int"))
    celex = F.concat(F.lit("3"), (k % 25 + 2000).cast("string"), letter, F.lpad((k % 10000).cast("string"), 4, "0"))
    domain.table(spark, sf_dir, "pages").select(F.to_json(F.struct(celex.alias("celex"), "html"))).write.text(f"{folder}/{saved_answers.EUROPEAN}")
    documents = saved_answers.scraped(saved_answers.saved_answers(spark, folder))
    return documents.select("source_id", "document_type", "jurisdiction", "title", F.col("metadata")["eli"].alias("eli"), "publication_date")


def _ranked_sql(source: str, key: str, text: str, words: tuple[str, ...], k: int, name: str) -> str:
    """BM25 over a table by brute force; the key is returned as ``name``."""
    wanted = ", ".join(f"'{w}'" for w in words)
    return f"""with t as (select {key} as key, list_filter(regexp_split_to_array(lower({text}), '\\W+'), lambda x: x <> '') as tokens from {source}),
      totals as (select count(*)::double as docs, avg(coalesce(len(tokens), 0)) as mean from t),
      hit as (select key, word, count(*)::double as n, any_value(length)::double as length from (select key, len(tokens) as length, unnest(tokens) as word from t)
        where word in ({wanted}) group by 1, 2),
      held as (select word, count(*)::double as d from hit group by 1),
      scored as (select key, sum(ln(1 + (docs - d + 0.5) / (d + 0.5)) * (n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean)))) as score
        from hit join held using (word) cross join totals group by key)
      select key as {name}, round(score, 6) as score, row_number() over (order by round(score, 9) desc, key)::int as rank from scored
      qualify row_number() over (order by round(score, 9) desc, key) <= {k}"""


def _searched(rows: DataFrame, key: str, text: str, words: str, k: int) -> DataFrame:
    spark = rows.sparkSession
    found = SearchIndex(spark, _folder(spark, "index")).build(rows, key, text).search(words, k)
    return found.select(F.col("key").alias(key), F.round("score", 6).alias("score"), "rank")


@query(_ranked_sql("part", "p_partkey", "p_name", ("red", "ring"), 25, "requirement_id"))
def o08_best_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best requirements of a search, by score and id, from the index."""
    return _searched(domain.requirements(spark, sf_dir), "requirement_id", "natural_language", "Red ring", 25)


@query(_ranked_sql("documents", "doc_id", "text", ("license", "river", "the"), 20, "doc_id"))
def f18_indexed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of a search with rare and frequent words, from the index."""
    return _searched(domain.table(spark, sf_dir, "documents"), "doc_id", "text", "the license, the river", 20)


def letters_of(texts: list[str]) -> list[list[float]]:
    """A provider that needs no network: how often each of five letters stands in a text."""
    return [[float(t.count(c)) for c in "aeiou"] for t in texts]


@query(
    """select doc_id, md5(text) as text_hash, array_to_string([length(x) - length(replace(x, c, '')) for c in ['a', 'e', 'i', 'o', 'u']], ',') as embedding
       from (select doc_id, text, substr(text, 1, 30000) as x from documents)"""
)
def n21_embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its embedding, in two runs of the cache: the second asks only for what the first has not."""
    cache, docs = EmbeddingCache(spark, _folder(spark, "embeddings"), "letters"), domain.table(spark, sf_dir, "documents").select("doc_id", "text")
    embedded(docs.where("doc_id % 2 = 0"), letters_of, cache)
    found = embedded(docs, letters_of, cache)
    return found.select("doc_id", "text_hash", F.array_join(F.transform("embedding", lambda x: x.cast("bigint")), ",").alias("embedding"))


@query(
    oracle(
        """select entity_id, name, case when entity_id % 9 = 0 then 'changed' when entity_id % 5 = 0 then 'new' else 'old' end as status from entities where entity_id % 100 <> 7
           union all select entity_id + 100000000, name, 'added' from entities where entity_id % 50 = 1"""
    )
)
def d02_written_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table on disk after an upsert, an update, a delete and an append with checks, each of which rewrites only the buckets of its keys."""
    rows = domain.entities(spark, sf_dir).select("entity_id", "name", F.lit("old").alias("status"))
    table = KeyedTable(spark, _folder(spark, "entities"), ("entity_id",), "entity_id bigint, name string, status string", buckets=16).create(rows)
    table.upsert(rows.where("entity_id % 5 = 0").withColumn("status", F.lit("new")))
    table.update(rows.where("entity_id % 9 = 0").select("entity_id", F.lit("changed").alias("status")))
    table.delete(rows.where("entity_id % 100 = 7"))
    added = rows.where("entity_id % 50 = 1").withColumn("entity_id", F.col("entity_id") + 100000000).withColumn("status", F.lit("added"))
    table.append(added.union(added.withColumn("status", F.lit(None)).withColumn("entity_id", F.col("entity_id") + 1)), ("no status", "status is not null"))
    return table.read()
