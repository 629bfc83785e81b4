"""Queries on assessments: counts, scores, history, tiers, workflow and table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regatta.functions.numbers import ratio, ratio_sql, whole
from regatta.operators import mutations, scoring
from regatta.plans.domain_sql import oracle
from regatta.plans.registry import query
from regatta.sources import domain

STATUS_WEIGHT = "case status when 'compliant' then 1.0 when 'partial' then 0.5 when 'remediation' then 0.3 else 0.0 end::double"
TIER_WEIGHT = "case tier when 'basic' then 1.0 when 'standard' then 1.5 when 'advanced' then 2.0 else 1.0 end::double"
RISK_WEIGHT = "case risk_impact when 'low' then 1.0 when 'medium' then 1.2 when 'high' then 1.5 when 'critical' then 2.0 else 1.0 end::double"
RISK_LEVEL = """case when simple_score < 0.5 or bad > 0.3 then 'critical' when simple_score < 0.7 or bad > 0.2 then 'high'
  when simple_score < 0.85 or bad > 0.1 then 'medium' else 'low' end"""


def _score_sql(key: str, source: str) -> str:
    return f"""select {key}, total, compliant, non_compliant, simple_score, weighted_score, risk_adjusted_score, {RISK_LEVEL} as risk_level from (
      select {key}, count(*)::bigint as total, count(*) filter (where status = 'compliant')::bigint as compliant,
        count(*) filter (where status = 'non_compliant')::bigint as non_compliant,
        count(*) filter (where status = 'non_compliant')::double / count(*) as bad,
        round(least(1.0::double, greatest(0.0::double, (count(*) filter (where status = 'compliant')
          + 0.5::double * count(*) filter (where status = 'partial')) / count(*))), 6) as simple_score,
        round(sum({TIER_WEIGHT} * {STATUS_WEIGHT}) / sum({TIER_WEIGHT}), 6) as weighted_score,
        round(sum({RISK_WEIGHT} * {STATUS_WEIGHT}) / sum({RISK_WEIGHT}), 6) as risk_adjusted_score
      from {source} where status <> 'not_applicable' group by {key})"""


RATED = """rated as (select a.entity_id, i.assessment_id, i.requirement_id, i.status, i.risk_impact, r.tier, r.regulation_id
  from items i join assessments a on i.assessment_id = a.assessment_id join requirements r on i.requirement_id = r.requirement_id
  where a.status = 'completed')"""
SCORED = f"""scored as (select s.*, a.entity_id, a.completed_at from ({_score_sql("assessment_id", "rated")}) s
  join assessments a on s.assessment_id = a.assessment_id)"""


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = domain.assessments(spark, sf_dir).where("status = 'completed'").select("assessment_id", "entity_id")
    facts = domain.requirements(spark, sf_dir).select("requirement_id", "tier", "regulation_id")
    return domain.items(spark, sf_dir).join(done, "assessment_id").join(facts, "requirement_id")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = domain.assessments(spark, sf_dir).select("assessment_id", "entity_id", "completed_at")
    return scoring.item_scores(_rated(spark, sf_dir), "assessment_id").join(when, "assessment_id")


@query(
    oracle(
        """select assessment_id, count(*)::bigint as total, count(*) filter (where status = 'compliant')::bigint as compliant,
             count(*) filter (where status = 'non_compliant')::bigint as non_compliant, count(*) filter (where status = 'partial')::bigint as partial,
             count(*) filter (where status = 'pending')::bigint as pending, count(*) filter (where status = 'not_applicable')::bigint as not_applicable,
             round(count(*) filter (where status = 'compliant')::double / nullif(count(*) filter (where status <> 'not_applicable'), 0), 6) as compliance_rate,
             round((count(*) - count(*) filter (where status = 'pending'))::double / count(*), 6) as completion_rate
           from items group by assessment_id"""
    )
)
def a05_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.count(F.when(F.col("status") == s, 1))
    total = F.count("*")
    return domain.items(spark, sf_dir).groupBy("assessment_id").agg(
        total.alias("total"), of("compliant").alias("compliant"), of("non_compliant").alias("non_compliant"), of("partial").alias("partial"),
        of("pending").alias("pending"), of("not_applicable").alias("not_applicable"),
        F.round(F.try_divide(of("compliant"), total - of("not_applicable")), 6).alias("compliance_rate"),
        F.round((total - of("pending")) / total, 6).alias("completion_rate"),
    )


@query(oracle(_score_sql("entity_id", "rated"), RATED))
def a08_entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.item_scores(_rated(spark, sf_dir), "entity_id")


@query(oracle(_score_sql("regulation_id", "rated"), RATED))
def a06_scores_by_regulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.item_scores(_rated(spark, sf_dir), "regulation_id")


@query(
    oracle(
        """select case when grouping(tier) = 0 then 'tier' when grouping(regulation_id) = 0 then 'regulation' else 'all' end as level,
             coalesce(tier, regulation_id, 'all') as key, count(*)::bigint as total,
             count(*) filter (where status = 'compliant')::bigint as compliant
           from rated where status <> 'not_applicable' group by grouping sets ((tier), (regulation_id), ())""",
        RATED,
    )
)
def a06_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall, by tier and by regulation in one pass over the items (grouping sets)."""
    rows = _rated(spark, sf_dir).where("status <> 'not_applicable'")
    counted = rows.groupingSets([[F.col("tier")], [F.col("regulation_id")], []], "tier", "regulation_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "compliant").alias("compliant"), F.grouping("tier").alias("_t"), F.grouping("regulation_id").alias("_r")
    )
    level = F.when(F.col("_t") == 0, "tier").when(F.col("_r") == 0, "regulation").otherwise("all")
    return counted.select(level.alias("level"), F.coalesce("tier", "regulation_id", F.lit("all")).alias("key"), "total", "compliant")


@query(
    oracle(
        f"""select assessment_id, entity_id, simple_score, previous, step / 1e6::double as change,
             case when previous > 0 then {ratio_sql("step * 100", "round(previous * 1000000)", 4)} end as change_pct,
             case when step > 10000 then 'improving' when step < -10000 then 'declining' else 'stable' end as trend
           from (select *, (round(simple_score * 1000000) - round(previous * 1000000))::bigint as step from (
             select assessment_id, entity_id, simple_score,
               lag(simple_score) over (partition by entity_id order by completed_at, assessment_id) as previous from scored))""",
        RATED,
        SCORED,
    )
)
def w02_score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("assessment_id", "entity_id", "completed_at", "simple_score")
    return scoring.history(rows, "entity_id", "completed_at", "simple_score", "assessment_id").drop("completed_at")


@query(
    oracle(
        """select entity_id, simple_score as previous_score from (select *, row_number() over
             (partition by entity_id order by completed_at desc, assessment_id desc) as n from scored) where n = 2""",
        RATED,
        SCORED,
    )
)
def w01_previous_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("entity_id").orderBy(F.desc("completed_at"), F.desc("assessment_id"))
    rows = _scored(spark, sf_dir).withColumn("_n", F.row_number().over(order)).where("_n = 2")
    return rows.select("entity_id", F.col("simple_score").alias("previous_score"))


@query(
    oracle(
        """select entity_id, round(sum(simple_score / n) / sum(1.0::double / n), 6) as recent_score, count(*)::bigint as n from (
             select entity_id, simple_score, row_number() over (partition by entity_id order by completed_at desc, assessment_id desc) as n
             from scored) where n <= 10 group by entity_id""",
        RATED,
        SCORED,
    )
)
def a11_recency_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.recency_weighted(_scored(spark, sf_dir), "entity_id", "completed_at", "simple_score", "assessment_id")


@query(
    oracle(
        f"""select entity_id, count(*)::bigint as n, {ratio_sql("sum(round(simple_score * 1000000)::bigint)", "count(*) * 1000000", 6)} as mean_score,
             count(*) filter (where simple_score >= 0.7)::bigint as good from scored group by entity_id""",
        RATED,
        SCORED,
    )
)
def a12_assessment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = ratio(F.sum(whole(F.col("simple_score"), 6)), F.count("*") * 1_000_000, 6)
    good = F.count(F.when(F.col("simple_score") >= 0.7, 1))
    return _scored(spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("n"), mean.alias("mean_score"), good.alias("good"))


@query(
    oracle(
        """select assessment_id, score, case when score >= 9500 then 1 when score >= 8500 then 2 when score >= 7000 then 3
             when score >= 5000 then 4 else 5 end::int as zk_tier, score >= 7000 as admissible
           from (select assessment_id, round(simple_score * 10000)::int as score from scored)""",
        RATED,
        SCORED,
    )
)
def f11_zk_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(F.col("simple_score") * 10000).cast("int").alias("score")
    rows = _scored(spark, sf_dir).select("assessment_id", score)
    return rows.select("assessment_id", "score", scoring.zk_tier(F.col("score")).alias("zk_tier"), (F.col("score") >= 7000).alias("admissible"))


CRITERIA = scoring.TierCriteria(
    advanced_sectors=("AUTOMOBILE",), standard_sectors=("BUILDING", "MACHINERY"), advanced_jurisdictions=("NATION_1", "NATION_2", "AMERICA", "ASIA")
)


@query(
    oracle(
        """select entity_id, case when p1 = top then 'basic' when p2 = top then 'standard' else 'advanced' end as tier,
             round(0.5::double + 0.5::double * (top - second) / top, 2) as confidence, risk from (
           select *, greatest(p1, p2, p3) as top, p1 + p2 + p3 - greatest(p1, p2, p3) - least(p1, p2, p3) as second from (
           select entity_id, risk,
             2 * (size = 1)::int + 3 * (sector = 1)::int + 2 * (geo = 1)::int + (kind = 1)::int as p1,
             2 * (size = 2)::int + 3 * (sector = 2)::int + 2 * (geo = 2)::int + (kind = 2)::int as p2,
             2 * (size = 3)::int + 3 * (sector = 3)::int + 2 * (geo = 3)::int + (kind = 3)::int as p3 from (
           select entity_id,
             greatest(case when employee_count >= 250 then 3 when employee_count >= 50 then 2 else 1 end,
               case when annual_revenue >= 50000000 then 3 when annual_revenue >= 10000000 then 2 else 1 end) as size,
             case when sectors[1] = 'AUTOMOBILE' then 3 when sectors[1] in ('BUILDING', 'MACHINERY') then 2 else 1 end as sector,
             case when hits >= 2 then 3 when hits = 1 then 2 else 1 end as geo,
             case entity_type when 'government' then 3 when 'corporation' then 2 else 1 end as kind,
             (case when employee_count >= 250 or annual_revenue >= 50000000 then 2.0 else 0.0 end
               + case when sectors[1] = 'AUTOMOBILE' then 3.0 when sectors[1] in ('BUILDING', 'MACHINERY') then 1.5 else 0.5 end
               + case when hits >= 2 then 2.5 when hits = 1 then 1.0 else 0.5 end)::double as risk
           from (select *, len(list_filter(jurisdictions, lambda x: x in ('NATION_1', 'NATION_2', 'AMERICA', 'ASIA'))) as hits from entities))))"""
    )
)
def f02_recommended_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.recommended_tier(domain.entities(spark, sf_dir), CRITERIA).select("entity_id", "tier", "confidence", "risk")


@query(
    oracle(
        """select regulation_id, tier, case tier when 'basic' then 5000 when 'standard' then 25000 else 100000 end
             + count(*)::bigint * case tier when 'basic' then 50 when 'standard' then 150 else 400 end as cost from requirements group by 1, 2"""
    )
)
def f09_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.requirements(spark, sf_dir).groupBy("regulation_id", "tier").agg(F.count("*").alias("n"))
    return rows.select("regulation_id", "tier", scoring.yearly_cost(F.col("tier"), F.col("n")).cast("bigint").alias("cost"))


@query(
    oracle(
        """select assessment_id, status, case status when 'pending_review' then 'completed' end as next_status, status = 'pending_review' as valid
           from assessments"""
    )
)
def p11_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What approving every assessment would do."""
    rows = domain.assessments(spark, sf_dir).select("assessment_id", "status")
    actions = rows.select("assessment_id", F.lit("approve").alias("action"))
    return mutations.transitioned(rows, actions).select("assessment_id", "status", "next_status", "valid")


@query(
    oracle(
        """select entity_id, name, status from (
             select entity_id, name, 'old' as status from entities where entity_id % 3 <> 0
             union all select entity_id, name, 'new' from entities where entity_id % 3 = 0)"""
    )
)
def d02_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = domain.entities(spark, sf_dir).select("entity_id", "name", F.lit("old").alias("status"))
    return mutations.upserted(base, base.where("entity_id % 3 = 0").withColumn("status", F.lit("new")), ["entity_id"])


@query(
    oracle(
        """select a.assessment_id, a.status, coalesce(c.n, 0)::bigint as items from assessments a
           left join (select assessment_id, count(*) as n from items group by 1) c on a.assessment_id = c.assessment_id"""
    )
)
def d03_update_from_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = domain.assessments(spark, sf_dir).select("assessment_id", "status", F.lit(0).cast("bigint").alias("items"))
    counts = domain.items(spark, sf_dir).groupBy("assessment_id").agg(F.count("*").alias("items"))
    return mutations.updated(base, counts, ["assessment_id"])


@query(oracle("select r.requirement_id from requirements r where r.regulation_id not in ('Brand#1', 'Brand#2')"))
def d04_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.requirements(spark, sf_dir).select("requirement_id", "regulation_id")
    regulations = rows.select("regulation_id").distinct()
    gone = regulations.where(F.col("regulation_id").isin("Brand#1", "Brand#2"))
    return mutations.cascaded(regulations, rows, gone, "regulation_id", "regulation_id")[1].select("requirement_id")


@query(
    oracle(
        """select a.entity_id, e.name, count(*)::bigint as assessments, count(*) filter (where a.status = 'completed')::bigint as completed,
             max(a.completed_at) as last_completed from assessments a join entities e on a.entity_id = e.entity_id group by 1, 2"""
    )
)
def j09_assessment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = domain.entities(spark, sf_dir).select("entity_id", "name")
    return domain.assessments(spark, sf_dir).join(names, "entity_id").groupBy("entity_id", "name").agg(
        F.count("*").alias("assessments"), F.count(F.when(F.col("status") == "completed", 1)).alias("completed"), F.max("completed_at").alias("last_completed")
    )
