"""Queries on documents as a whole, dates in free text, replies, approvals, paging and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.functions import text as tx
from regatta.functions.dates import fuzzy_date
from regatta.operators import graph, mutations, rml, scoring
from regatta.operators.rules import page_flags
from regatta.plans.assessing import _score_sql
from regatta.plans.domain_sql import oracle
from regatta.plans.registry import query
from regatta.sources import domain

#: Forms of a day, as Spark writes them and with words around.
FORMS = ("yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy", "MM/dd/yyyy", "'on 'EEEE', the 'd' of 'MMM yyyy", "yyyyMMdd", "MMM d yyyy HH:mm:ss", "yyyy.MM.dd", "'effective 'MMM'. 'd', 'yyyy")


@query("select o_orderkey, case when o_orderkey % 10 < 9 then o_orderdate::date end as day from orders")
def f26_fuzzy_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of every order, written in nine forms by its key (and not at all in a tenth of the rows), and read again."""
    k = F.col("o_orderkey") % 10
    written = F.lit("the thirtieth of next month, 2024")
    for i, form in enumerate(FORMS):
        written = F.when(k == i, F.date_format("o_orderdate", form)).otherwise(written)
    return domain.table(spark, sf_dir, "orders").select("o_orderkey", fuzzy_date(written).alias("day"))


@query(
    """select p_partkey as id, case when p_partkey % 4 <> 3 then p_name end as logic, case when p_partkey % 4 <> 3 then p_size end as size from part"""
)
def f25_object_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object out of each reply: bare, fenced, with prose around, or cut short."""
    k, whole = F.col("p_partkey"), F.to_json(F.struct(F.col("p_name").alias("formal_logic"), F.col("p_size").alias("size")))
    fenced = F.concat(F.lit("```json\n"), whole, F.lit("\n```"))
    prose = F.concat(F.lit("Here it is: "), whole, F.lit(" - as asked."))
    reply = F.when(k % 4 == 0, whole).when(k % 4 == 1, fenced).when(k % 4 == 2, prose).otherwise(F.concat(F.lit("sorry {"), "p_name"))
    rows = domain.table(spark, sf_dir, "part").select("p_partkey", tx.object_from_reply(reply, "formal_logic string, size int").alias("r"))
    return rows.select(F.col("p_partkey").alias("id"), F.col("r.formal_logic").alias("logic"), F.col("r.size").alias("size"))


FINAL = """approved as (select assessment_id, entity_id, timestamp '2024-02-01' + to_hours((assessment_id % 24)::int) as completed_at from assessments where status = 'pending_review' and assessment_id % 3 <> 0),
  open_items as (select i.assessment_id, i.requirement_id, i.status, i.risk_impact, r.tier from items i join approved a on i.assessment_id = a.assessment_id
    join requirements r on i.requirement_id = r.requirement_id)"""


def _approved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Assessments after the approval of two in three of those under review, and the rated items of all."""
    waiting = domain.assessments(spark, sf_dir).where("status = 'pending_review'")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    base = waiting.select(
        "assessment_id", "entity_id", "status", none("timestamp_ntz", "started_at"), none("timestamp_ntz", "completed_at"), none("string", "approver"),
        none("string", "reviewer"), none("timestamp_ntz", "updated_at"),
    )
    actions = base.select("assessment_id", F.when(F.col("assessment_id") % 3 != 0, "approve").otherwise("archive").alias("action"), F.lit("board").alias("user"))
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("assessment_id") % 24).cast("int"))
    facts = domain.requirements(spark, sf_dir).select("requirement_id", "tier")
    return mutations.transition_effects(base, actions, at), domain.items(spark, sf_dir).join(facts, "requirement_id")


@query(
    oracle(
        f"""select a.assessment_id, a.entity_id, round(coalesce(s.simple_score, 0), 4) as overall_score, coalesce(s.total, 0)::bigint as total
            from approved a left join ({_score_sql("assessment_id", "open_items")}) s using (assessment_id)""",
        FINAL,
    )
)
def d05_final_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overall score that each approval makes final."""
    after, items = _approved(spark, sf_dir)
    return scoring.finalised(after, items).select("assessment_id", "entity_id", "overall_score", "total")


@query(
    oracle(
        f"""select entity_id, max_by(assessment_id, (completed_at, assessment_id)) as last_assessment_id, max(completed_at) as last_assessment_at,
              max_by(score, (completed_at, a.assessment_id)) as compliance_score
            from approved a join (select assessment_id, round(coalesce(s.simple_score, 0), 4) as score from approved
              left join ({_score_sql("assessment_id", "open_items")}) s using (assessment_id)) using (assessment_id) group by entity_id""",
        FINAL,
    )
)
def d05_entities_after_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What approvals leave on their entities: the last assessment, its time and score."""
    return scoring.last_assessments(scoring.finalised(*_approved(spark, sf_dir)))


@query(
    oracle(
        """select r.regulation_id as id, coalesce(g.name, r.regulation_id) as name, r.requirement_id, r.tier, 'https://example.org/' || r.regulation_id as url,
             sha256(r.regulation_id) as source_hash, (select string_agg(kind || ':' || target, ',' order by kind, target) from (
                 select 'cites' as kind, dst as target from depends_on where src = r.requirement_id and src % 2 = 0
                 union all select 'depends_on', dst from depends_on where src = r.requirement_id and src % 2 = 1
                 union all select 'conflicts_with', dst from conflicts where src = r.requirement_id)) as links,
             round((r.requirement_id % 100) / 100, 2) as confidence
           from requirements r left join regulations g using (regulation_id)"""
    )
)
def n17_whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with source, references and metadata, flattened again: a row per requirement."""
    need = domain.requirements(spark, sf_dir).withColumn("confidence", F.round((F.col("requirement_id") % 100) / 100, 2))
    depends, conflicts = domain.depends_on(spark, sf_dir), domain.conflicts(spark, sf_dir)
    kind = F.when(F.col("src") % 2 == 0, "cites").otherwise("depends_on")
    links = depends.select("src", "dst", kind.alias("type")).union(conflicts.select("src", "dst", F.lit("conflicts_with")))
    sources = need.select("regulation_id").distinct().select(
        "regulation_id", F.concat(F.lit("https://example.org/"), "regulation_id").alias("url"), F.sha2("regulation_id", 256).alias("hash")
    )
    docs = rml.generated(need, regulations=domain.regulations(spark, sf_dir), sources=sources, links=links)
    flat = docs.select("id", "name", "source", F.explode("requirements").alias("r"))
    told = F.transform(F.array_sort("r.references"), lambda x: F.concat(x["type"], F.lit(":"), x["target"].cast("string")))
    return flat.select(
        "id", "name", F.col("r.id").alias("requirement_id"), "r.tier", F.col("source.url").alias("url"), F.col("source.hash").alias("source_hash"),
        F.nullif(F.array_join(told, ","), F.lit("")).alias("links"), F.col("r.metadata.confidence").alias("confidence"),
    )


@query(
    oracle(
        """select page, count(*)::bigint as n, page < max_page as has_next, page > 1 as has_previous from (
             select ((row_number() over (order by requirement_id) - 1) // 30 + 1)::bigint as page, ((count(*) over () + 29) // 30)::bigint as max_page from requirements) group by page, max_page"""
    )
)
def p10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of 30 of the requirements, with whether there is a next and a previous one."""
    rows = domain.requirements(spark, sf_dir).select("requirement_id")
    placed = scoring.numbered(rows, "requirement_id").withColumn("page", F.floor((F.col("place") - 1) / 30) + 1)
    pages = F.ceil(F.lit(rows.count()) / 30)
    after, before = page_flags(F.col("page"), pages)
    return placed.groupBy("page").agg(F.count("*").alias("n")).select("page", "n", after.alias("has_next"), before.alias("has_previous"))


@query(
    oracle(
        """select area, depth, count(distinct entity_id)::bigint as entities from (select e.entity_id, w.area, w.depth
             from entities e join chain w on list_contains(e.jurisdictions, w.code)) group by area, depth""",
        """parts as (select n_name as code, r_name as parent from nation join region on n_regionkey = r_regionkey union all select r_name, 'WORLD' from region)""",
        """chain(code, area, depth) as (select code, parent, 1 from parts union all select c.code, p.parent, c.depth + 1 from chain c join parts p on c.area = p.code)""",
    )
)
def g12_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities within each area, over all steps of the hierarchy from an entity's jurisdictions up."""
    places = domain.jurisdictions(spark, sf_dir)
    parts = places.select("code", "parent").union(places.select("parent").distinct().select("parent", F.lit("WORLD")))
    edges = parts.select(F.col("code").alias("src"), F.col("parent").alias("dst"))
    within = graph.reachable(edges, edges.select(F.col("src").alias("root")).distinct(), None)
    own = domain.entities(spark, sf_dir).select("entity_id", F.explode("jurisdictions").alias("root"))
    return own.join(within, "root").groupBy(F.col("node").alias("area"), "depth").agg(F.countDistinct("entity_id").alias("entities"))


GROUPS = "grown as (select requirement_id as root, regulation_id from requirements where requirement_id % 50 = 0)"


def _walks(edges: str, depth: int) -> str:
    return f"""walk(root, node, depth) as (select root, root, 0 from grown union
      select w.root, e.dst, w.depth + 1 from walk w join {edges} e on w.node = e.src where w.depth < {depth})"""


def _grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.requirements(spark, sf_dir).where("requirement_id % 50 = 0").select(F.col("requirement_id").alias("root"), "regulation_id")


@query(
    oracle(
        """select p.root, p.target, min(w.depth)::int as hops from (select root, regulation_id, min(root) over (partition by regulation_id) as target from grown) p
           join walk w on w.root = p.root and w.node = p.target where p.root <> p.target group by 1, 2""",
        GROUPS,
        "both_ways as (select src, dst from depends_on union select dst, src from depends_on)",
        _walks("both_ways", 6),
    )
)
def g07_paths_in_regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest path of up to six steps from each requirement divisible by 50 to the first such one of its regulation."""
    grown = _grown(spark, sf_dir)
    first = grown.groupBy("regulation_id").agg(F.min("root").alias("target"))
    pairs = grown.join(first, "regulation_id").where("root <> target").select("root", "target")
    return graph.paths_between(domain.depends_on(spark, sf_dir), pairs, 6).select("root", "target", F.col("hops").cast("int").alias("hops"))


@query(
    oracle(
        """select regulation_id, node, max(depth)::bigint as farthest from (select g.regulation_id, any_value(g.size) as size, w.root, w.node, min(w.depth) as depth
             from sized g join walk w on w.root = g.root group by g.regulation_id, w.root, w.node)
           group by regulation_id, node having count(*) = any_value(size)""",
        GROUPS,
        "sized as (select *, count(*) over (partition by regulation_id) as size from grown)",
        _walks("depends_on", 5),
    )
)
def g09_shared_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all requirements divisible by 50 of a regulation depend on, within five steps."""
    roots = _grown(spark, sf_dir).withColumnRenamed("regulation_id", "of")
    found = graph.shared_ancestors(domain.depends_on(spark, sf_dir), roots, 5)
    return found.select(F.col("of").alias("regulation_id"), "node", "farthest")
