"""The domain tables as DuckDB common table expressions, the start of every oracle query."""

from __future__ import annotations

import re

from regatta.sources.domain import LEGAL_TEXT


def quoted(text: str) -> str:
    """A string literal of DuckDB; line feeds stand as chr(10)."""
    return "(" + " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in text.split("\n")) + ")"


def as_sql(template: str) -> str:
    """A template as an expression: literal pieces, and whole numbers as expressions in braces."""
    return " || ".join(f"({x})::varchar" if i % 2 else quoted(x) for i, x in enumerate(re.split("[{}]", template)))


LEGAL = as_sql(LEGAL_TEXT)

DOMAIN = f"""
jurisdictions as (select n_nationkey, n_name as code, r_name as parent from nation join region on n_regionkey = r_regionkey),
entities as (
  select c_custkey as entity_id, c_name as name,
         case c_mktsegment when 'AUTOMOBILE' then 'corporation' when 'BUILDING' then 'sme' when 'FURNITURE' then 'startup'
           when 'HOUSEHOLD' then 'non_profit' when 'MACHINERY' then 'government' end as entity_type,
         [code, parent] as jurisdictions, [c_mktsegment] as sectors, ((c_custkey * 37) % 400)::int as employee_count,
         c_acctbal * 10000 as annual_revenue, c_custkey % 50 = 0 as deleted
  from customer join jurisdictions on c_nationkey = n_nationkey),
requirements as (
  select p_partkey as requirement_id, p_brand as regulation_id, p_name as natural_language,
         case when p_size <= 20 then 'basic' when p_size <= 40 then 'standard' else 'advanced' end as tier, p_type as method,
         case when p_partkey % 10 = 0 then ['ALL'] when p_partkey % 11 = 0 then null
           else ['NATION_' || (p_partkey % 25), 'NATION_' || ((3 * p_partkey) % 25)] end as jurisdictions,
         case when p_partkey % 7 = 0 then ['ALL']
           else [(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[(p_partkey % 5 + 1)::int]] end as sectors,
         case when p_partkey % 3 != 0 then p_retailprice * 1000 end as penalty, (p_partkey % 7 + 1)::int as layer,
         (date '2020-01-01' + (p_size * 30)::int) as effective_date
  from part),
regulations as (
  select regulation_id, 'Regulation ' || n as name, 'NATION_' || (n % 25) as jurisdiction, ['NATION_' || ((n * 2) % 25)] as jurisdictions,
         date '2020-01-01' + n as effective_date
  from (select distinct p_brand as regulation_id, try_cast(regexp_extract(p_brand, '([0-9]+)$', 1) as int) as n from part) where n % 2 = 1
  union all select 'Draft', 'Regulation in draft', 'NATION_1', null, null),
legal_texts as (select k as doc_id, {LEGAL} as text from (select p_partkey as k from part)),
assessments as (
  select o_orderkey as assessment_id, o_custkey as entity_id,
         case o_orderstatus when 'F' then 'completed' when 'O' then 'in_progress' when 'P' then 'pending_review' end as status,
         case when o_orderstatus = 'F' then o_orderdate end as completed_at, o_orderdate as created_at
  from orders),
items as (
  select l_orderkey as assessment_id, l_partkey as requirement_id, l_linenumber as line,
         case l_returnflag || l_linestatus when 'AF' then 'compliant' when 'AO' then 'partial' when 'NF' then 'non_compliant'
           when 'NO' then 'pending' when 'RF' then 'remediation' when 'RO' then 'not_applicable' end as status,
         case when round(l_discount * 100) <= 2 then 'low' when round(l_discount * 100) <= 5 then 'medium'
           when round(l_discount * 100) <= 8 then 'high' else 'critical' end as risk_impact
  from lineitem),
states as (
  select entity_id, requirement_id, status, completed_at from (
    select a.entity_id, i.requirement_id, i.status, a.completed_at,
           row_number() over (partition by a.entity_id, i.requirement_id order by a.completed_at desc, a.assessment_id desc, i.status) as n
    from items i join assessments a on i.assessment_id = a.assessment_id where a.status = 'completed') where n = 1),
depends_on as (
  select p_partkey as src, p_partkey // 2 as dst from part where p_partkey > 1
  union all select p_partkey, 499 from part where p_partkey = 1),
conflicts as (
  select p_partkey as src, p_partkey + 17 as dst from part
  where p_partkey % 13 = 0 and p_partkey + 17 in (select p_partkey from part)),
compliance_events as (
  select event_id, ts, user_id as entity_id,
         case event_type when 'error' then 'violation.detected' when 'click' then 'assessment.started' when 'view' then 'score.calculated'
           when 'purchase' then 'assessment.completed' when 'signup' then 'entity.created' end as event_type,
         trunc(value * 20)::int as score, props
  from events),
applicable as (
  select e.entity_id, r.requirement_id, r.tier, r.penalty, r.regulation_id
  from entities e join requirements r
    on (list_has_any(r.jurisdictions, e.jurisdictions) or list_contains(r.jurisdictions, 'ALL'))
   and (list_has_any(r.sectors, e.sectors) or list_contains(r.sectors, 'ALL')))
"""


def oracle(select: str, *more: str) -> str:
    """A query over the domain tables; ``more`` are further common table expressions."""
    return f"with recursive {', '.join([DOMAIN.strip(), *more])} {select}"
