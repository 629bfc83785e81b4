"""Graph queries on all rows."""

from __future__ import annotations

from regatta.operators import applicability as ap
from regatta.operators import graph
from regatta.plans.catalog import QUERIES
from regatta.sources import domain


def test_every_cycle_is_found_at_any_length(spark):
    ring = [(i, i % 25 + 1) for i in range(1, 26)]
    edges = spark.createDataFrame([*ring, (30, 31), (31, 30), (31, 40), (40, 41), (50, 1), (60, 60)], "src bigint, dst bigint")
    got = {r.root: r.cycle_length for r in graph.cycles(edges).collect()}
    assert got == {i: 25 for i in range(1, 26)} | {30: 2, 31: 2, 60: 1}
    assert graph.cycles(edges.limit(0)).count() == 0


def test_all_requirements_on_a_cycle(spark, small):
    ids = {r.src for r in domain.depends_on(spark, small).select("src").collect()}
    walk = [1, 499]
    while walk[-1] != 1:
        walk.append(walk[-1] // 2)
    expected = {i: len(walk) - 1 for i in walk} if 499 in ids else {}
    assert {r.root: r.cycle_length for r in QUERIES["g03_cycles_whole"](spark, small).collect()} == expected


def test_paths_of_all_entities(spark, small):
    need = domain.requirements(spark, small)
    pairs = ap.applicable(domain.entities(spark, small), need).collect()
    e = {r.entity_id: r.jurisdictions for r in domain.entities(spark, small).collect()}
    r = {x.requirement_id: x for x in need.collect()}
    expected = {(a, b, r[b].regulation_id, j) for a, b, *_ in pairs for j in set(e[a]) & set(r[b].jurisdictions or [])}
    got = [(x.entity_id, x.requirement_id, x.regulation_id, x.jurisdiction) for x in QUERIES["g06_compliance_paths_whole"](spark, small).collect()]
    assert len({i for i, *_ in got if i % 10 != 1}) > 0 and len(got) == len(expected) and set(got) == expected


def test_roots_grow_with_the_table(spark, small):
    grown = {r.requirement_id for r in domain.requirements(spark, small).where("requirement_id % 50 = 0").collect()}
    for name, column, expected in (("g01_dependency_chain_whole", "root", grown - {0}), ("g08_impact_whole", "requirement_id", grown)):
        assert {r[column] for r in QUERIES[name](spark, small).select(column).collect()} == expected  # 0 depends on nothing
