"""Queries on the requirement graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.operators import applicability as ap
from regatta.operators import graph
from regatta.plans.domain_sql import oracle
from regatta.plans.registry import query
from regatta.sources import domain

def _reach(edges: str, roots: str, depth: int) -> str:
    return f"""walk(root, node, depth) as (select src, dst, 1 from {edges} where src in ({roots})
      union select w.root, e.dst, w.depth + 1 from walk w join {edges} e on w.node = e.src where w.depth < {depth})"""


def _grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots that grow with the table: the requirements whose id is divisible by 50."""
    return domain.requirements(spark, sf_dir).where("requirement_id % 50 = 0").select(F.col("requirement_id").alias("root"))


GROWN = "select requirement_id from requirements where requirement_id % 50 = 0"
BACK = "back as (select dst as src, src as dst from depends_on)"


@query(oracle("select root, node, min(depth)::int as depth from walk group by root, node", _reach("depends_on", GROWN, 10)))
def g01_dependency_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(domain.depends_on(spark, sf_dir), _grown(spark, sf_dir), 10)


@query(oracle("select root, node, min(depth)::int as depth from walk group by root, node", BACK, _reach("back", GROWN, 4)))
def g02_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(graph.reversed_edges(domain.depends_on(spark, sf_dir)), _grown(spark, sf_dir), 4)


@query(oracle("select root, min(depth)::int as cycle_length from walk where root = node group by root", _reach("depends_on", "select src from depends_on", 40)))
def g03_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every requirement on a cycle of any length, with the length of its shortest (the SQL follows 40 steps, the longest cycle of the tables has 9)."""
    return graph.cycles(domain.depends_on(spark, sf_dir))


@query(oracle("select distinct least(src, dst) as a, greatest(src, dst) as b from conflicts"))
def g04_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.conflict_pairs(domain.conflicts(spark, sf_dir))


ENTITY_CONFLICTS = """ends as (select src as requirement_id from conflicts union select dst from conflicts),
  codes as (select requirement_id, tier, unnest(jurisdictions) as code, sectors from requirements where requirement_id in (select requirement_id from ends)),
  areas as (select requirement_id, tier, code, unnest(sectors) as sector from codes),
  places as (select entity_id, unnest(list_append(jurisdictions, 'ALL')) as code, list_append(sectors, 'ALL') as sectors from entities),
  fields as (select entity_id, code, unnest(sectors) as sector from places),
  held as (select distinct entity_id, requirement_id, tier from fields join areas using (code, sector)),
  met as (select x.entity_id, c.a, c.b,
      case when 'advanced' in (x.tier, y.tier) then 'high' when 'standard' in (x.tier, y.tier) then 'medium' else 'low' end as severity
    from (select distinct least(src, dst) as a, greatest(src, dst) as b from conflicts) c join held x on x.requirement_id = c.a
    join held y on y.requirement_id = c.b and y.entity_id = x.entity_id)"""


def _conflicting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return domain.entities(spark, sf_dir), domain.conflicts(spark, sf_dir), domain.requirements(spark, sf_dir)


@query(oracle("select entity_id, a, b, severity from met", ENTITY_CONFLICTS))
def g05_entity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_conflicts(*_conflicting(spark, sf_dir))


@query(
    oracle(
        """select entity_id, count(*)::bigint as total_conflicts, count(*) filter (where severity = 'high')::bigint as high_severity,
             count(*) filter (where severity = 'medium')::bigint as medium_severity, count(*) filter (where severity = 'low')::bigint as low_severity
           from met group by entity_id""",
        ENTITY_CONFLICTS,
    )
)
def a17_conflict_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.severity_counts(*_conflicting(spark, sf_dir))


@query(
    oracle(
        """select a.entity_id, a.requirement_id, a.regulation_id, g.name as regulation_name, u.jurisdiction from applicable a
           join (select entity_id, unnest(jurisdictions) as jurisdiction from entities) u on a.entity_id = u.entity_id
           join requirements r on a.requirement_id = r.requirement_id left join regulations g on a.regulation_id = g.regulation_id
           where list_contains(r.jurisdictions, u.jurisdiction)"""
    )
)
def g06_compliance_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all entities over a jurisdiction to requirements, with the name of the regulation where it is known."""
    names = domain.regulations(spark, sf_dir).select("regulation_id", F.col("name").alias("regulation_name"))
    return ap.paths(domain.entities(spark, sf_dir), domain.requirements(spark, sf_dir).join(names, "regulation_id", "left"), "regulation_name")


@query(
    oracle(
        "select root, min(depth)::int as hops from walk where node = 3 and root <> 3 group by root",
        "both_ways as (select src, dst from depends_on union select dst, src from depends_on)",
        _reach("both_ways", GROWN, 10),
    )
)
def g07_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.shortest_paths(domain.depends_on(spark, sf_dir), _grown(spark, sf_dir), 3, 10)
    return found.select("root", F.col("hops").cast("int").alias("hops"))


@query(
    oracle(
        """select r.id::bigint as requirement_id, (select count(*) from applicable a where a.requirement_id = r.id)::bigint as entities,
             (select count(distinct node) from walk w where w.root = r.id and w.node <> r.id)::bigint as dependents,
             (select count(*) from (select src, dst from conflicts union select dst, src from conflicts) c where c.src = r.id)::bigint as conflicts
           from (select requirement_id as id from requirements where requirement_id % 50 = 0) r""",
        BACK,
        _reach("back", GROWN, 10),
    )
)
def g08_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    need, roots = domain.requirements(spark, sf_dir), _grown(spark, sf_dir)
    asked = need.join(roots, need.requirement_id == roots.root, "left_semi")
    return graph.impact(ap.entities_of(domain.entities(spark, sf_dir), asked), domain.depends_on(spark, sf_dir), domain.conflicts(spark, sf_dir), need, roots)


@query(
    oracle(
        """select node, max(depth)::bigint as farthest from (select root, node, min(depth) as depth from (
             select * from walk union all select unnest([40, 41, 83]), unnest([40, 41, 83]), 0) group by root, node)
           group by node having count(distinct root) = 3""",
        _reach("depends_on", "40, 41, 83", 5),
    )
)
def g09_common_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.common_ancestors(domain.depends_on(spark, sf_dir), spark.createDataFrame([(i,) for i in (40, 41, 83)], "root bigint"), 3, 5)


@query(None)
def g01_dependency_chain_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(domain.depends_on(spark, sf_dir), _grown(spark, sf_dir), 10)


@query(None)
def g02_dependents_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(graph.reversed_edges(domain.depends_on(spark, sf_dir)), _grown(spark, sf_dir), 4)


@query(None)
def g03_cycles_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every requirement on a cycle of any length, with the length of its shortest."""
    return graph.cycles(domain.depends_on(spark, sf_dir))


@query(None)
def g06_compliance_paths_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ap.paths(domain.entities(spark, sf_dir), domain.requirements(spark, sf_dir))


@query(None)
def g07_shortest_path_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.shortest_paths(domain.depends_on(spark, sf_dir), _grown(spark, sf_dir), 3, 10)
    return found.select("root", F.col("hops").cast("int").alias("hops"))


@query(None)
def g08_impact_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g08_impact(spark, sf_dir)


FIRSTS = """lists as (select r.requirement_id,
    (select string_agg(node, ',' order by depth, node) from (select node, min(depth) as depth from walk w where w.root = r.requirement_id and w.node <> r.requirement_id
       group by node order by depth, node limit 10)) as dependents,
    (select string_agg(other, ',' order by other) from (select case when src = r.requirement_id then dst else src end as other from conflicts
       where src = r.requirement_id or dst = r.requirement_id order by other limit 5)) as conflicts
  from requirements r where r.requirement_id % 50 = 0)"""


@query(oracle("select requirement_id, coalesce(dependents, '') as dependents, coalesce(conflicts, '') as conflicts from lists", BACK, _reach("back", GROWN, 10), FIRSTS))
def g08_impact_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest dependents and the first five conflicts of each requirement."""
    roots = _grown(spark, sf_dir)
    near = graph.reachable(graph.reversed_edges(domain.depends_on(spark, sf_dir)), roots, 10).where("root <> node")
    near = graph.first_of(near, "root", ["depth", "node"], "node", 10).withColumnRenamed("first", "_near")
    against = graph.undirected(domain.conflicts(spark, sf_dir)).select(F.col("src").alias("root"), "dst").join(roots, "root", "left_semi")
    against = graph.first_of(against, "root", ["dst"], "dst", 5).withColumnRenamed("first", "_against")
    listed = lambda c, name: F.coalesce(F.array_join(c, ","), F.lit("")).alias(name)
    met = roots.join(near, "root", "left").join(against, "root", "left")
    return met.select(F.col("root").alias("requirement_id"), listed("_near", "dependents"), listed("_against", "conflicts"))
