"""Queries on nested regulation documents, validations and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.operators import rml
from regatta.plans.domain_sql import oracle
from regatta.plans.registry import query
from regatta.sources import domain


@query(
    oracle(
        """select regulation_id as id, count(*)::int as total, count(*) filter (where tier = 'basic')::int as basic,
             count(*) filter (where tier = 'standard')::int as standard, count(*) filter (where tier = 'advanced')::int as advanced,
             min(requirement_id) as first_requirement from requirements group by 1"""
    )
)
def n17_regulation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rml.statistics(domain.requirements(spark, sf_dir))


@query(oracle("select regulation_id as id, requirement_id, tier from requirements"))
def s14_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON and read back under an explicit schema."""
    docs = rml.generated(domain.requirements(spark, sf_dir))
    back = rml.decoded(rml.encoded(docs), "id string, requirements array<struct<id: bigint, tier: string>>")
    return back.select("id", F.explode("requirements").alias("r")).select("id", F.col("r.id").alias("requirement_id"), "r.tier")


@query(
    oracle(
        """select 'BELONGS_TO' as type, requirement_id::varchar as src, regulation_id as dst from requirements
           union all select 'APPLIES_TO_JURISDICTION', requirement_id::varchar, unnest(list_distinct(jurisdictions)) from requirements
           union all select 'APPLIES_TO_SECTOR', requirement_id::varchar, unnest(list_distinct(sectors)) from requirements
           union all select 'DEPENDS_ON', src::varchar, dst::varchar from depends_on where src in (select requirement_id from requirements)
             and dst in (select requirement_id from requirements)
           union all select 'CONFLICTS_WITH', src::varchar, dst::varchar from conflicts"""
    )
)
def n20_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = domain.depends_on(spark, sf_dir).withColumn("kind", F.lit("depends_on"))
    links = links.union(domain.conflicts(spark, sf_dir).withColumn("kind", F.lit("conflicts_with")))
    links = links.union(domain.conflicts(spark, sf_dir).withColumn("kind", F.lit("cites")))
    return rml.graph_edges(domain.requirements(spark, sf_dir), links)


@query(
    oracle(
        """select requirement_id, unnest(list_filter([case when jurisdictions is null then 'missing jurisdiction' end,
             case when trim(natural_language) = '' then 'missing text' end], lambda e: e is not null)) as error from requirements"""
    )
)
def p12_validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rml.validation_errors(domain.requirements(spark, sf_dir))


@query(
    oracle(
        """select requirement_id, regulation_id from (select *, row_number() over (partition by regulation_id, words order by requirement_id) as n
             from (select *, list_sort(list_distinct(string_split(lower(natural_language), ' '))) as words from requirements)) where n = 1"""
    )
)
def n16_unique_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of two words are alike by more than 0.9 only if they have the same words, which the SQL relies on."""
    return rml.greedy_unique(domain.requirements(spark, sf_dir))


@query(None)
def n15_extracted_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rml.extracted(domain.table(spark, sf_dir, "documents"))


@query(
    oracle(
        """select doc_id, 'REQ-' || doc_id || '-' || lpad(row_number() over (partition by doc_id order by place)::varchar, 3, '0') as requirement_id, kind, sentence from (
             select doc_id, place, sentence, case when regexp_matches(lower(sentence), '\\b(shall|must|may) not\\b') then 'prohibition'
               when regexp_matches(lower(sentence), '\\b(shall|must|is required to)\\b') then 'obligation' when regexp_matches(lower(sentence), '\\bmay\\b') then 'permission' end as kind
             from (select doc_id, unnest(parts) as sentence, generate_subscripts(parts, 1) as place from (
               select doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as parts from legal_texts))) where kind is not null"""
    )
)
def n15_extracted_from_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rml.extracted(domain.legal_texts(spark, sf_dir))


@query(None)
def n09_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rml.sections(domain.table(spark, sf_dir, "documents"))


@query(None)
def f19_entity_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.entities(spark, sf_dir).select("entity_id", rml.entity_hash(F.col("entity_id").cast("string")).alias("hash"))


@query(oracle("select requirement_id, '3' || year(effective_date) || 'R' || lpad((requirement_id % 10000)::varchar, 4, '0') as celex from requirements"))
def f27_celex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.requirements(spark, sf_dir)
    return rows.select("requirement_id", rml.celex(F.year("effective_date"), "R", F.col("requirement_id") % 10000).alias("celex"))


@query(
    oracle(
        """select r.requirement_id, coalesce(s.n, 0)::bigint as assessed, s.n is not null as known from requirements r
           left join (select requirement_id, count(*) as n from states group by 1) s on r.requirement_id = s.requirement_id"""
    )
)
def j18_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = domain.states(spark, sf_dir).groupBy("requirement_id").agg(F.count("*").alias("n"))
    met = domain.requirements(spark, sf_dir).select("requirement_id").join(counts, "requirement_id", "left")
    return met.select("requirement_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("assessed"), F.col("n").isNotNull().alias("known"))


@query(
    oracle(
        """select jurisdiction, parent, count(*)::bigint as entities from (select e.entity_id, j.code as jurisdiction, j.parent
             from entities e join jurisdictions j on list_contains(e.jurisdictions, j.code)) group by 1, 2"""
    )
)
def g12_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by jurisdiction and the one it is part of."""
    own = domain.entities(spark, sf_dir).select("entity_id", F.explode("jurisdictions").alias("jurisdiction"))
    places = domain.jurisdictions(spark, sf_dir).select(F.col("code").alias("jurisdiction"), "parent")
    return own.join(places, "jurisdiction").groupBy("jurisdiction", "parent").agg(F.count("*").alias("entities"))
