"""Queries on applicability, compliance, gaps and the requirement catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.functions.text import contains
from regatta.operators import applicability as ap
from regatta.plans.domain_sql import oracle
from regatta.plans.registry import query
from regatta.sources import domain

COUNTS = """count(*)::bigint as total, count(*) filter (where status = 'compliant')::bigint as compliant,
  count(*) filter (where status = 'non_compliant')::bigint as non_compliant, count(*) filter (where status = 'partial')::bigint as partial,
  count(*) filter (where status = 'pending')::bigint as pending, count(*) filter (where status = 'exempt')::bigint as exempt,
  count(*) filter (where status is null or status = 'unknown')::bigint as unknown,
  round(count(*) filter (where status = 'compliant')::double / count(*), 6) as compliance_rate,
  round((count(*) filter (where status = 'non_compliant') + 0.5::double * count(*) filter (where status = 'partial')) / count(*), 6) as risk_score"""
JOINED = """joined as (select a.*, s.status from applicable a left join states s
  on a.entity_id = s.entity_id and a.requirement_id = s.requirement_id)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ap.applicable(domain.entities(spark, sf_dir), domain.requirements(spark, sf_dir))


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ap.with_states(_pairs(spark, sf_dir), domain.states(spark, sf_dir))


@query(oracle("select entity_id, requirement_id from applicable"))
def j01_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(oracle(f"select entity_id, {COUNTS} from joined group by entity_id", JOINED))
def a01_compliance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ap.compliance(domain.entities(spark, sf_dir), domain.requirements(spark, sf_dir), domain.states(spark, sf_dir))


@query(oracle(f"select entity_id, tier, {COUNTS} from joined group by entity_id, tier", JOINED))
def a02_score_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ap.compliance(domain.entities(spark, sf_dir), domain.requirements(spark, sf_dir), domain.states(spark, sf_dir), by="tier")


@query(
    oracle(
        f"""select entity_id, jurisdiction, {COUNTS} from (
          select j.entity_id, j.requirement_id, j.status, u.jurisdiction
          from joined j join (select entity_id, unnest(jurisdictions) as jurisdiction from entities) u on j.entity_id = u.entity_id
          join requirements r on j.requirement_id = r.requirement_id
          where list_contains(r.jurisdictions, u.jurisdiction) or list_contains(r.jurisdictions, 'ALL')) group by entity_id, jurisdiction""",
        JOINED,
    )
)
def a03_score_by_jurisdiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ap.compliance(domain.entities(spark, sf_dir), domain.requirements(spark, sf_dir), domain.states(spark, sf_dir), by="jurisdiction")


@query(
    oracle(
        """select a.entity_id, a.requirement_id from applicable a where not exists (select 1 from states s
           where s.entity_id = a.entity_id and s.requirement_id = a.requirement_id and s.status = 'compliant')"""
    )
)
def j04_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = domain.states(spark, sf_dir).where("status = 'compliant'").select("entity_id", "requirement_id")
    return ap.open_requirements(domain.entities(spark, sf_dir), domain.requirements(spark, sf_dir), closed).drop("priority")


@query(
    oracle(
        """select a.entity_id, a.requirement_id, a.tier, a.regulation_id, g.name as regulation_name,
             case a.tier when 'advanced' then 'critical' when 'standard' then 'high' else 'medium' end as priority
           from applicable a left join regulations g on a.regulation_id = g.regulation_id
           where not exists (select 1 from states s where s.entity_id = a.entity_id and s.requirement_id = a.requirement_id and s.status = 'compliant')"""
    )
)
def j05_named_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps with their priority and the name of their regulation, where it is known."""
    names = domain.regulations(spark, sf_dir).select("regulation_id", F.col("name").alias("regulation_name"))
    named = domain.requirements(spark, sf_dir).join(names, "regulation_id", "left").withColumn("urgency", ap.gap_priority(F.col("tier")))
    closed = domain.states(spark, sf_dir).where("status = 'compliant'").select("entity_id", "requirement_id")
    found = ap.open_requirements(domain.entities(spark, sf_dir), named, closed, "tier", "regulation_id", "regulation_name", "urgency")
    return found.drop("priority").withColumnRenamed("urgency", "priority")


@query(
    oracle(
        """select entity_id, requirement_id, tier, penalty, regulation_id,
             row_number() over (partition by entity_id order by case tier when 'advanced' then 1 when 'standard' then 2 else 3 end,
               penalty desc nulls last, requirement_id)::bigint as priority
           from joined where status is null or status in ('non_compliant', 'partial', 'pending')""",
        JOINED,
    )
)
def w03_ranked_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = domain.states(spark, sf_dir).where("status not in ('non_compliant', 'partial', 'pending')").select("entity_id", "requirement_id")
    return ap.open_requirements(domain.entities(spark, sf_dir), domain.requirements(spark, sf_dir), closed, "tier", "penalty", "regulation_id")


@query(
    oracle(
        """select entity_id, count(*)::bigint as critical_gaps, max(penalty) as largest_penalty from joined
           where (status is null or status in ('non_compliant', 'partial')) and (tier = 'advanced' or penalty > 1000000) group by entity_id""",
        JOINED,
    )
)
def a29_critical_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open gaps of requirements that are advanced or cost more than a million."""
    critical = domain.requirements(spark, sf_dir).where("tier = 'advanced' or penalty > 1000000")
    closed = domain.states(spark, sf_dir).where("status is not null and status not in ('non_compliant', 'partial')").select("entity_id", "requirement_id")
    return ap.open_totals(domain.entities(spark, sf_dir), critical, closed).withColumnRenamed("number", "critical_gaps")


@query(
    oracle(
        """select entity_id, count(*) filter (where status = 'compliant')::bigint as compliant,
             count(*) filter (where status = 'non_compliant')::bigint as non_compliant, count(*) filter (where status = 'partial')::bigint as partial,
             count(*) filter (where status not in ('compliant', 'non_compliant', 'partial'))::bigint as not_assessed from states group by entity_id"""
    )
)
def a16_state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ap.state_summary(domain.states(spark, sf_dir))


@query(
    oracle(
        """select requirement_id, regulation_id, tier from requirements
           where tier in ('standard', 'advanced') and list_has_any(jurisdictions, ['NATION_1', 'NATION_2', 'NATION_3'])
             and layer <= 5 and effective_date >= date '2021-01-01' and effective_date <= date '2023-12-31'"""
    )
)
def p01_requirement_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = [
        F.col("tier").isin("standard", "advanced"),
        F.arrays_overlap("jurisdictions", F.array(*map(F.lit, ("NATION_1", "NATION_2", "NATION_3")))),
        F.col("layer") <= 5,
        F.col("effective_date").between("2021-01-01", "2023-12-31"),
    ]
    rows = domain.requirements(spark, sf_dir)
    for t in tests:
        rows = rows.where(t)
    return rows.select("requirement_id", "regulation_id", "tier")


@query(oracle("select requirement_id, natural_language from requirements where contains(lower(natural_language), 'ring')"))
def p07_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.requirements(spark, sf_dir)
    return rows.where(contains(F.col("natural_language"), "Ring")).select("requirement_id", "natural_language")


@query(oracle("select entity_id, name from entities where not deleted and list_contains(jurisdictions, 'ASIA')"))
def p08_live_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.entities(spark, sf_dir).where(~F.col("deleted") & F.array_contains("jurisdictions", "ASIA")).select("entity_id", "name")


@query(oracle("select tier, count(*)::bigint as n from requirements group by tier"))
def a13_count_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.requirements(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))


@query(oracle("select j as jurisdiction, count(*)::bigint as n from (select unnest(jurisdictions) as j from requirements) group by j"))
def a14_count_by_jurisdiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.requirements(spark, sf_dir).select(F.explode("jurisdictions").alias("jurisdiction")).groupBy("jurisdiction").agg(F.count("*").alias("n"))


@query(
    oracle(
        """select g.regulation_id, g.name, count(r.requirement_id)::bigint as requirements, count(distinct r.tier)::bigint as tiers
           from regulations g left join requirements r on g.regulation_id = r.regulation_id group by 1, 2"""
    )
)
def j12_requirements_per_regulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every regulation with the number of its requirements, 0 where it has none."""
    counts = domain.requirements(spark, sf_dir).groupBy("regulation_id").agg(F.count("*").alias("requirements"), F.countDistinct("tier").alias("tiers"))
    return domain.regulations(spark, sf_dir).select("regulation_id", "name").join(counts, "regulation_id", "left").fillna(0, ["requirements", "tiers"])


@query(oracle("select requirement_id, tier from requirements order by tier, requirement_id limit 20 offset 40"))
def o02_page_of_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.requirements(spark, sf_dir).select("requirement_id", "tier").orderBy("tier", "requirement_id").offset(40).limit(20)


@query(oracle("select count(*)::bigint as total, greatest(1, ceil(count(*) / 20.0))::bigint as pages from entities where not deleted"))
def a21_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return domain.entities(spark, sf_dir).where(~F.col("deleted")).agg(n.alias("total"), F.greatest(F.lit(1), F.ceil(n / 20)).cast("bigint").alias("pages"))


@query(
    oracle(
        """select 'entities' as kind, count(*)::bigint as n from entities union all select 'requirements', count(*) from requirements
           union all select 'depends_on', count(*) from depends_on union all select 'conflicts_with', count(*) from conflicts"""
    )
)
def a15_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {
        "entities": domain.entities, "requirements": domain.requirements, "depends_on": domain.depends_on, "conflicts_with": domain.conflicts,
    }
    out = None
    for kind, f in parts.items():
        one = f(spark, sf_dir).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.union(one)
    return out


@query(
    oracle(
        """select distinct e.entity_id, r.requirement_id from entities e join requirements r on list_has_any(e.jurisdictions, r.jurisdictions)"""
    )
)
def j15_applies_by_jurisdiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ap.applicable(domain.entities(spark, sf_dir), domain.requirements(spark, sf_dir), sectors=False, wildcard=False)


@query(
    oracle(
        """select requirement_id, array_to_string(list_filter(jurisdictions, lambda x: x in ('NATION_1', 'NATION_3', 'ALL')), ',') as matching
           from requirements where list_has_any(jurisdictions, ['NATION_1', 'NATION_3', 'ALL'])"""
    )
)
def u08_matching_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("NATION_1", "NATION_3", "ALL")
    rows = domain.requirements(spark, sf_dir).where(F.arrays_overlap("jurisdictions", F.array(*map(F.lit, wanted))))
    return rows.select("requirement_id", F.array_join(F.filter("jurisdictions", lambda x: x.isin(*wanted)), ",").alias("matching"))
