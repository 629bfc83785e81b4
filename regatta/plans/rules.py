"""Queries on the rules of one expression each: flags, admissibility, names, units, codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.functions import text as tx
from regatta.operators import rml, rules, scoring
from regatta.plans.domain_sql import oracle
from regatta.plans.registry import query
from regatta.sources import domain
from regatta.sources.domain import mapped


def _cases(key: str, values: dict[str, str], default: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"case {key} " + " ".join(f"when {quote(k)} then {quote(v)}" for k, v in values.items()) + f" else {default} end"


CHANGES = """changes as (select event_id, case when event_id % 97 = 0 then '' else entity_id::varchar end as entity_id,
    case event_type when 'violation.detected' then 'VIOLATION' when 'assessment.completed' then 'COMPLIANT' when 'score.calculated' then 'FLAGGED' else 'UNKNOWN' end as status,
    ['halal', 'esg', 'itar', 'other'][(event_id % 4 + 1)::int] as domain, (event_id % 110)::int as score from compliance_events)"""
ADMISSIBLE = "(entity_id <> '' and status in ('COMPLIANT', 'VIOLATION', 'FLAGGED') and domain in ('halal', 'esg', 'itar') and score between 0 and 100)"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State changes as a chain would report them; some are not admissible."""
    status = {"violation.detected": "VIOLATION", "assessment.completed": "COMPLIANT", "score.calculated": "FLAGGED"}
    place = (F.col("event_id") % 4 + 1).cast("int")
    return domain.events(spark, sf_dir).select(
        "event_id", F.when(F.col("event_id") % 97 == 0, "").otherwise(F.col("entity_id").cast("string")).alias("entity_id"),
        F.coalesce(mapped(F.col("event_type"), status), F.lit("UNKNOWN")).alias("status"),
        F.element_at(F.array(*map(F.lit, ("halal", "esg", "itar", "other"))), place).alias("domain"), (F.col("event_id") % 110).cast("int").alias("score"), "ts",
    )


@query(oracle(f"select event_id, {ADMISSIBLE} as accepted from changes", CHANGES))
def p13_state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which state changes may be recorded."""
    rows = _changes(spark, sf_dir)
    return rows.select("event_id", rules.admissible(*map(F.col, ("entity_id", "status", "domain", "score"))).alias("accepted"))


@query(
    oracle(
        f"""select event_id, rule, case rule when 'RECALCULATE_FIT_IQ' then 0.4 else 0.0 end::double as penalty from (
              select event_id, unnest(['RECALCULATE_FIT_IQ', 'FLAG_SETTLEMENT']) as rule from changes where {ADMISSIBLE} and status = 'VIOLATION')""",
        CHANGES,
    )
)
def p16_violation_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changes(spark, sf_dir)
    accepted = rows.where(rules.admissible(*map(F.col, ("entity_id", "status", "domain", "score"))))
    return rules.violation_effects(accepted).select("event_id", "rule", "penalty")


@query(
    oracle(
        f"""select entity_id, max_by(status, event_id) as status, max_by(score, event_id)::int as score, count(*) filter (where status = 'VIOLATION')::bigint as violations
            from changes where {ADMISSIBLE} group by entity_id""",
        CHANGES,
    )
)
def t13_chain_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest recorded state of each entity and how often it violated."""
    rows = _changes(spark, sf_dir)
    accepted = rows.where(rules.admissible(*map(F.col, ("entity_id", "status", "domain", "score"))))
    return accepted.groupBy("entity_id").agg(
        F.max_by("status", "event_id").alias("status"), F.max_by("score", "event_id").alias("score"), F.count(F.when(F.col("status") == "VIOLATION", 1)).alias("violations")
    )


@query(
    oracle(
        """select assessment_id, status in ('approved', 'completed', 'rejected') as complete, created_at + interval 365 day < timestamp '1999-06-01' as expired,
             case status when 'completed' then assessment_id % 5 = 0 or created_at + interval 365 day >= timestamp '1999-06-01' else false end as evidence_valid
           from assessments"""
    )
)
def p10_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness and expiry of assessments, and validity of the evidence handed in with them, on a given day."""
    as_of = F.lit("1999-06-01 00:00:00").cast("timestamp_ntz")
    until = F.col("created_at") + F.expr("interval 365 day")
    kind = F.when(F.col("status") == "completed", "verified").otherwise("pending")
    return domain.assessments(spark, sf_dir).select(
        "assessment_id", rules.is_complete(F.col("status")).alias("complete"), rules.is_expired(until, as_of).alias("expired"),
        rules.evidence_is_valid(kind, F.col("assessment_id") % 5 == 0, until, as_of).alias("evidence_valid"),
    )


@query(
    oracle(
        """select event_id, score between 0 and 10000 and score >= 7000 as over_threshold, score between 2500 and 7500 as in_range,
             case when score between 9500 and 10000 then 1 when score between 8500 and 9499 then 2 when score between 7000 and 8499 then 3
               when score between 5000 and 6999 then 4 when score between 0 and 4999 then 5 end is not distinct from (event_id % 5 + 1) as in_tier from compliance_events"""
    )
)
def p14_provable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For which claims about a score a proof exists: at least 7000, between 2500 and 7500, and of a claimed tier."""
    score = F.col("score")
    return domain.events(spark, sf_dir).select(
        "event_id", rules.provable_threshold(score, F.lit(7000)).alias("over_threshold"), rules.provable_range(score, F.lit(2500), F.lit(7500)).alias("in_range"),
        rules.provable_tier(score, F.col("event_id") % 5 + 1).alias("in_tier"),
    )


@query(
    oracle(
        """select entity_id, score as verified_score, tier, coalesce(ts + interval 10 day >= timestamp '2024-01-25' and tier <= 3, false) as compliant from (
             select *, case when score >= 9500 then 1 when score >= 8500 then 2 when score >= 7000 then 3 when score >= 5000 then 4 else 5 end::int as tier from (
               select entity_id, max_by(score, (ts, event_id)) as score, max(ts) as ts from compliance_events where event_type = 'assessment.completed' group by entity_id))"""
    )
)
def f12_compliant_at_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose latest verification holds ten days and is of tier 3 or better on a given day."""
    done = domain.events(spark, sf_dir).where("event_type = 'assessment.completed'")
    last = done.groupBy("entity_id").agg(F.max_by("score", F.struct("ts", "event_id")).alias("verified_score"), F.max("ts").alias("ts"))
    last = last.withColumn("tier", scoring.zk_tier(F.col("verified_score")))
    as_of, until = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), F.col("ts") + F.expr("interval 10 day")
    return last.select("entity_id", "verified_score", "tier", rules.compliant_at_tier(F.col("ts"), until, F.col("tier"), F.lit(3), as_of).alias("compliant"))


DIDS = """dids as (select 'did:example:' || entity_id as did, entity_id from entities where entity_id % 4 <> 0),
  credentials as (select o_orderkey as credential_id, 'did:example:' || o_custkey as did, case o_orderstatus when 'F' then 'active' when 'P' then 'revoked' else
    case when o_orderkey % 3 = 0 then 'suspended' else 'active' end end as status, o_orderdate + interval 730 day as expires_at from orders)"""


def _dids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = domain.entities(spark, sf_dir).where("entity_id % 4 <> 0")
    return e.select(F.concat(F.lit("did:example:"), F.col("entity_id").cast("string")).alias("did"), "entity_id")


def _credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.when(F.col("o_orderkey") % 3 == 0, "suspended").otherwise("active")
    status = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "P", "revoked").otherwise(rest)
    return domain.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("credential_id"), F.concat(F.lit("did:example:"), F.col("o_custkey").cast("string")).alias("did"), status.alias("status"),
        (F.col("o_orderdate") + F.expr("interval 730 day")).alias("expires_at"),
    )


@query(oracle("select c.credential_id, d.entity_id from credentials c join dids d on c.did = d.did", DIDS))
def j19_credential_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity behind the identifier that a credential names."""
    return _credentials(spark, sf_dir).join(_dids(spark, sf_dir), "did").select("credential_id", "entity_id")


@query(
    oracle(
        """select asked.id as credential_id, coalesce(message = 'Credential is valid', false) as valid, message from (select o_orderkey * 2 as id from orders) asked
           left join lateral (select case when c.credential_id is null then 'Credential not found' when c.status = 'revoked' then 'Credential has been revoked'
             when c.status = 'suspended' then 'Credential is suspended' when timestamp '2000-01-01' > c.expires_at then 'Credential has expired'
             else 'Credential is valid' end as message from (select 1) one left join credentials c on c.credential_id = asked.id) on true""",
        DIDS,
    )
)
def j20_credential_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether asked-for credentials exist and hold on a given day."""
    asked = domain.table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2).alias("credential_id"))
    met = asked.join(_credentials(spark, sf_dir).withColumn("_found", F.lit(True)), "credential_id", "left")
    found = F.coalesce("_found", F.lit(False))
    valid, message = rules.credential_state(found, F.col("status"), F.col("expires_at"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
    return met.select("credential_id", valid.alias("valid"), message.alias("message"))


def _catalogue_sql() -> str:
    rows = [(t, *rules.TIER_REGIMES[t], i, c) for t, items in rules.CAPABILITIES.items() for i, c in enumerate(items)]
    values = ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)
    return f"""select r.regulation_id, r.tier, c.assessment_frequency, c.evidence, c.monitoring, c.position, c.capability
      from (select distinct regulation_id, tier from requirements) r
      join (values {values}) c(tier, assessment_frequency, evidence, monitoring, position, capability) on r.tier = c.tier"""


@query(oracle(_catalogue_sql()))
def f10_tier_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each tier that a regulation asks for requires."""
    return rules.tier_catalogue(domain.requirements(spark, sf_dir).select("regulation_id", "tier").distinct())


@query(
    oracle(
        """select requirement_id, case tier when 'basic' then 4 when 'standard' then 5 else 0 end::int as triggers,
             case tier when 'basic' then 'Exceed $10,000,000 annual revenue' when 'standard' then 'Exceed $50,000,000 annual revenue' end as second from requirements"""
    )
)
def f10_upgrade_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.upgrade_triggers(F.col("tier"))
    return domain.requirements(spark, sf_dir).select("requirement_id", F.size(found).alias("triggers"), F.get(found, F.lit(1)).alias("second"))


@query(
    oracle(
        """select assessment_id, (created_at::date + 365)::date as next_due, (created_at::date + 30)::date as default_due, (assessment_id % 26)::double / 5 / 5 * 100 as percentage
           from assessments"""
    )
)
def f14_due_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("created_at").cast("date")
    score = (F.col("assessment_id") % 26).cast("double") / 5
    return domain.assessments(spark, sf_dir).select(
        "assessment_id", rules.next_due(day).alias("next_due"), rules.default_due(day).alias("default_due"), rules.score_percentage(score).alias("percentage")
    )


@query(
    oracle(
        """select event_id, sha256('{"entity_id": ' || entity_id || ', "event_type": "' || event_type || '", "name": "\\u00c4 ' || event_id || '", "score": ' || score || '}') as data_hash
           from compliance_events"""
    )
)
def f15_canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of an event's canonical JSON, whatever the order of its fields."""
    name = F.concat(F.lit("Ä "), F.col("event_id").cast("string"))
    text = F.to_json(F.struct("score", name.alias("name"), "event_type", "entity_id"))
    return domain.events(spark, sf_dir).select("event_id", tx.canonical_hash(rules.canonical_json(text)).alias("data_hash"))


@query("select doc_id, md5(text) as cache_key from documents")
def f16_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("cache_key"))


@query(
    oracle(
        """select event_id, event_id || ',' || (event_id + 1) || ',' || score || ',' || (score + 1) || ',' || (score + 2) || ',' || (score + 3) || ',7,8' as calldata,
             case when event_id % 9 = 0 then '' else (score * 3)::varchar end as commitment, true as round_trip from compliance_events"""
    )
)
def f20_proof_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs as call data and as hexadecimal text and back, and the commitment among their signals."""
    number = lambda c: c.cast("string")
    e, s = F.col("event_id"), F.col("score")
    proof = F.struct(
        F.array(number(e), number(e + 1)).alias("pi_a"), F.array(F.array(number(s), number(s + 1)), F.array(number(s + 2), number(s + 3))).alias("pi_b"),
        F.array(F.lit("7"), F.lit("8")).alias("pi_c"),
    )
    signals = F.when(e % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(number(e), number(s * 3)))
    rows = domain.events(spark, sf_dir).select("event_id", proof.alias("proof"), signals.alias("signals"))
    back = rules.from_hex(rules.to_hex(F.col("proof")), "pi_a array<string>, pi_b array<array<string>>, pi_c array<string>")
    return rows.select("event_id", F.array_join(rules.calldata(F.col("proof")), ",").alias("calldata"), rules.commitment(F.col("signals")).alias("commitment"), (back == F.col("proof")).alias("round_trip"))


@query(oracle("""select event_id, regexp_extract(props, '"k": ([0-9]+)', 1)::int as k, null::varchar as missing from compliance_events"""))
def f23_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.try_parse_json("props")
    return domain.events(spark, sf_dir).select("event_id", F.try_variant_get(parsed, "$.k", "int").alias("k"), F.try_variant_get(parsed, "$.risk_factors", "string").alias("missing"))


@query(
    oracle(
        """select event_id, case when event_id % 5 <> 0 then score end::int as first_score, case when event_id % 5 <> 0 then 2 end::int as n from compliance_events"""
    )
)
def f25_json_from_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays saved from replies with fences and prose around them; a reply cut short has none."""
    s = F.col("score").cast("string")
    whole = F.concat(F.lit('Here it is:\n```json\n[{"score": '), s, F.lit('}, {"score": 0}]\n```\nDone.'))
    reply = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('[{"score": '), s)).otherwise(whole)
    found = tx.json_from_reply(reply, "array<struct<score: int>>")
    return domain.events(spark, sf_dir).select("event_id", F.get(found, F.lit(0))["score"].alias("first_score"), F.nullif(F.size(found), F.lit(-1)).alias("n"))


@query(
    oracle(
        """select requirement_id, case requirement_id % 5 when 4 then null else effective_date end as parsed, strftime(effective_date, '%Y%m') as year_month,
             (date '2024-01-01' - effective_date)::int as age_days from requirements"""
    )
)
def f26_parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in four ways, and one that is none; month keys and ages in days."""
    forms = ("yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy", "MM/dd/yyyy")
    text = F.lit("no date")
    for i, form in enumerate(forms):
        text = F.when(F.col("requirement_id") % 5 == i, F.date_format("effective_date", form)).otherwise(text)
    day = F.col("effective_date")
    return domain.requirements(spark, sf_dir).select(
        "requirement_id", tx.parsed_date(text).alias("parsed"), F.date_format(day, "yyyyMM").alias("year_month"), F.date_diff(F.lit("2024-01-01").cast("date"), day).alias("age_days")
    )


@query(
    oracle(
        """select requirement_id, case requirement_id % 4 when 1 then 'directive' else 'regulation' end as type,
             '3' || year(effective_date) || ['R', 'L', 'D', 'X'][(requirement_id % 4 + 1)::int] || lpad((requirement_id % 10000)::varchar, 4, '0') as celex from requirements"""
    )
)
def f27_celex_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("requirement_id")
    celex = None
    for i, sign in enumerate("RLDX"):
        own = rml.celex(F.year("effective_date"), sign, k % 10000)
        celex = F.when(k % 4 == i, own) if celex is None else celex.when(k % 4 == i, own)
    rows = domain.requirements(spark, sf_dir).select("requirement_id", celex.alias("celex"))
    return rows.select("requirement_id", rules.celex_type(F.col("celex")).alias("type"), "celex")


CODES = "['RULE', 'PRORULE', 'NOTICE', 'PRESDOCU', 'REG', 'DIR', 'DEC', 'TREATY', 'RECOMMENDATION', 'OPINION', 'MEMO'][(doc_id % 11 + 1)::int]"


@query(f"select doc_id, code, {_cases('code', rules.FEDERAL_TYPES | rules.UNION_TYPES, 'null')} as type from (select doc_id, {CODES} as code from documents)")
def f28_document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of documents by the codes of two publishers; null for codes that neither has."""
    codes = (*rules.FEDERAL_TYPES, *rules.UNION_TYPES, "MEMO")
    code = F.element_at(F.array(*map(F.lit, codes)), (F.col("doc_id") % 11 + 1).cast("int"))
    return domain.table(spark, sf_dir, "documents").select("doc_id", code.alias("code")).withColumn("type", mapped(F.col("code"), rules.FEDERAL_TYPES | rules.UNION_TYPES))


@query(oracle("select distinct event_type as metric, case when contains(event_type, 'score') then 'score' else 'count' end as unit from compliance_events"))
def f30_metric_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.events(spark, sf_dir).select(F.col("event_type").alias("metric"), rules.metric_unit(F.col("event_type")).alias("unit")).distinct()


@query(oracle("select entity_id, requirement_id, 'CS-' || entity_id || '-' || requirement_id as state_id from states"))
def f33_state_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.states(spark, sf_dir).select("entity_id", "requirement_id", rules.state_id(F.col("entity_id"), F.col("requirement_id")).alias("state_id"))


@query(
    oracle(
        f"""select requirement_id, {_cases("j", rules.JURISDICTION_NAMES, "j")} as jurisdiction, case j when 'EU' then 'regional' else 'national' end as layer,
              {_cases("s", rules.SECTOR_NAMES, "s")} as sector from (
              select requirement_id, ['US', 'EU', 'DE', 'ZZ'][(requirement_id % 4 + 1)::int] as j, ['TECH', 'ALL', 'MINING'][(requirement_id % 3 + 1)::int] as s from requirements)"""
    )
)
def f34_names_of_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("requirement_id")
    pick = lambda *codes: F.element_at(F.array(*map(F.lit, codes)), (k % len(codes) + 1).cast("int"))
    rows = domain.requirements(spark, sf_dir).select("requirement_id", pick("US", "EU", "DE", "ZZ").alias("j"), pick("TECH", "ALL", "MINING").alias("s"))
    return rows.select(
        "requirement_id", rules.named(F.col("j"), rules.JURISDICTION_NAMES).alias("jurisdiction"), rules.governance_layer(F.col("j")).alias("layer"),
        rules.named(F.col("s"), rules.SECTOR_NAMES).alias("sector"),
    )


@query(
    oracle(
        """select requirement_id, case when requirement_id % 17 = 0 then 'basic' else tier end as tier,
             case when requirement_id % 3 = 0 then 'document_review' else 'self_attestation' end as method from requirements"""
    )
)
def f35_coerced_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers and methods that are not known become the defaults."""
    k = F.col("requirement_id")
    tier = F.when(k % 17 == 0, "gold").otherwise(F.col("tier"))
    method = F.when(k % 3 == 0, "document_review").when(k % 3 == 1, F.col("method"))
    return domain.requirements(spark, sf_dir).select(
        "requirement_id", rules.known_or(tier, rules.TIERS, "basic").alias("tier"), rules.known_or(method, rules.METHODS, "self_attestation").alias("method")
    )


@query(
    oracle(
        """select entity_id, case when compliant + bad + partial = 0 then 0.0::double else (compliant + partial * 0.5::double) / (compliant + bad + partial) * 100 end as rate from (
             select entity_id, count(*) filter (where status = 'compliant') as compliant, count(*) filter (where status = 'non_compliant') as bad,
               count(*) filter (where status = 'partial') as partial from states group by entity_id)"""
    )
)
def a31_assessed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.count(F.when(F.col("status") == s, 1))
    rate = rules.assessed_rate(of("compliant"), of("non_compliant"), of("partial"))
    return domain.states(spark, sf_dir).groupBy("entity_id").agg(rate.alias("rate"))


@query(
    oracle(
        """select case event_id % 3 when 0 then 'threshold' when 1 then 'range' else 'tier' end as circuit, count(*)::bigint as total,
             count(*) filter (where score between 5000 and 10000)::bigint as valid,
             count(*) filter (where score not between 5000 and 10000)::bigint as invalid from compliance_events group by 1"""
    )
)
def a22_batch_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a batch of claims by circuit; a claim holds where its score can be proved to reach 5000, which it can up to 10,000 only."""
    k, holds = F.col("event_id") % 3, rules.provable_threshold(F.col("score"), F.lit(5000))
    circuit = F.when(k == 0, "threshold").when(k == 1, "range").otherwise("tier")
    return domain.events(spark, sf_dir).groupBy(circuit.alias("circuit")).agg(
        F.count("*").alias("total"), F.count(F.when(holds, 1)).alias("valid"), F.count(F.when(~holds, 1)).alias("invalid")
    )


@query(
    oracle(
        """select entity_id, tier, points from (select entity_id, points, case when p1 >= p2 and p1 >= p3 then 'basic' when p2 >= p3 then 'standard' else 'advanced' end as tier from (
             select entity_id, weight + 2 * (size = 3)::int as points, 2 * (size = 1)::int + 3 + 2 + 1 + 2 * (risky = 1)::int as p1, 2 * (size = 2)::int + 2 * (risky = 2)::int as p2,
               2 * (size = 3)::int + 2 * (risky = 3)::int as p3 from (
               select *, case when weight >= 4 then 3 when weight >= 2 then 2 else 1 end as risky from (
                 select entity_id, case entity_id % 3 when 0 then 3 when 1 then 2 else 1 end as size,
                   (entity_id % 2 = 0)::int * 2 + (entity_id % 5 = 0)::int * 1 + (entity_id % 7 = 0)::int * 2 as weight from entities))))"""
    )
)
def f07_risk_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommended tier of entities known by size category and risk factors alone."""
    k = F.col("entity_id")
    factors = F.create_map(
        F.lit("processes_sensitive_data"), k % 2 == 0, F.lit("publicly_traded"), k % 5 == 0, F.lit("government_contractor"), k % 7 == 0, F.lit("unheard_of"), F.lit(True)
    )
    none = F.array().cast("array<string>")
    rows = domain.entities(spark, sf_dir).select(
        "entity_id", F.lit("sme").alias("entity_type"), F.lit(None).cast("int").alias("employee_count"), F.lit(None).cast("double").alias("annual_revenue"),
        F.element_at(F.array(*map(F.lit, ("LARGE", "medium", "Small"))), (k % 3 + 1).cast("int")).alias("size"), none.alias("sectors"), none.alias("jurisdictions"),
        factors.alias("risk_factors"),
    )
    return scoring.recommended_tier(rows).select("entity_id", "tier", F.col("risk").cast("int").alias("points"))
