"""Rules of one expression each: flags, codes, names, units and admissibility."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regatta.sources.domain import mapped

# Fixed values of the rules.
TIERS = ("basic", "standard", "advanced")
METHODS = ("self_attestation", "document_review", "cryptographic_proof", "on_site_audit", "automated_monitoring")
CHAIN_STATUS = ("COMPLIANT", "VIOLATION", "FLAGGED")
CHAIN_DOMAINS = ("halal", "esg", "itar")
CHAIN_SCORE, FULL_SCORE = 100, 10_000
#: What a violation on the chain sets off, and by how much it lowers the fit.
VIOLATION_RULES = (("RECALCULATE_FIT_IQ", 0.4), ("FLAG_SETTLEMENT", 0.0))
#: Least and greatest score (of ten thousand) of the numeric tiers.
TIER_BOUNDS = {1: (9500, 10000), 2: (8500, 9499), 3: (7000, 8499), 4: (5000, 6999), 5: (0, 4999)}
JURISDICTION_NAMES = {
    "US": "United States", "EU": "European Union", "UK": "United Kingdom", "CA": "Canada", "AU": "Australia", "SG": "Singapore", "JP": "Japan",
    "CN": "China", "DE": "Germany", "FR": "France",
}
SECTOR_NAMES = {
    "FINANCE": "Financial Services", "HEALTH": "Healthcare", "TECH": "Technology", "ENERGY": "Energy", "MANUFACTURING": "Manufacturing",
    "RETAIL": "Retail", "TRANSPORT": "Transportation", "GOVERNMENT": "Government", "ALL": "All Sectors",
}
FEDERAL_TYPES = {"RULE": "rule", "PRORULE": "proposed_rule", "NOTICE": "notice", "PRESDOCU": "executive_order"}
UNION_TYPES = {
    "REG": "regulation", "DIR": "directive", "DEC": "regulation", "TREATY": "regulation", "RECOMMENDATION": "guidance", "OPINION": "notice",
}
CELEX_TYPES = {"R": "regulation", "L": "directive", "D": "regulation"}
CAPABILITIES = {
    "basic": ("Self-attestation support", "Basic document management", "Annual assessment cycle"),
    "standard": (
        "Document review workflows", "Quarterly assessment cycle", "Evidence management", "Multi-jurisdiction tracking", "Risk scoring",
    ),
    "advanced": (
        "Continuous monitoring", "Real-time compliance tracking", "Automated evidence collection", "Third-party audit support",
        "Zero-knowledge proofs", "Cryptographic attestations", "Advanced analytics",
    ),
}
#: How often a tier is assessed, by which evidence, and how it is watched.
TIER_REGIMES = {
    "basic": ("Annual", "Self-attestation", "None"),
    "standard": ("Quarterly", "Document review", "Periodic"),
    "advanced": ("Continuous", "Automated + cryptographic", "Real-time"),
}


def evidence_is_valid(status: Column, perpetual: Column, valid_until: Column, as_of: Column) -> Column:
    """Verified evidence that never ends or has not ended; without an end it is valid."""
    return F.coalesce((status == "verified") & (perpetual | valid_until.isNull() | (valid_until >= as_of)), F.lit(False))


def is_complete(status: Column) -> Column:
    """Assessments that were decided, whether they say approved or completed for it."""
    return status.isin("approved", "completed", "rejected")


def is_expired(expires_at: Column, as_of: Column) -> Column:
    return F.coalesce(as_of > expires_at, F.lit(False))


def page_flags(page: Column, pages: Column) -> tuple[Column, Column]:
    """Whether a page has a next one and a previous one."""
    return page < pages, page > 1


def admissible(entity_id: Column, status: Column, domain: Column, score: Column) -> Column:
    """State changes that may be recorded: a known entity, status and domain, and a score of 0 to 100."""
    known = (entity_id != "") & status.isin(*CHAIN_STATUS) & domain.isin(*CHAIN_DOMAINS) & score.between(0, CHAIN_SCORE)
    return F.coalesce(known, F.lit(False))


def violation_effects(changes: DataFrame) -> DataFrame:
    """A row per rule that an admissible violation sets off: ``rule`` and ``penalty``."""
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(p).alias("penalty")) for r, p in VIOLATION_RULES))
    return changes.where("status = 'VIOLATION'").withColumn("_r", F.explode(rules)).select(*changes.columns, "_r.rule", "_r.penalty")


def provable_threshold(score: Column, threshold: Column) -> Column:
    """A proof that a score reaches a threshold exists only for values up to ten thousand."""
    return score.between(0, FULL_SCORE) & threshold.between(0, FULL_SCORE) & (score >= threshold)


def provable_range(score: Column, least: Column, most: Column) -> Column:
    return (least <= most) & (most <= FULL_SCORE) & (least >= 0) & score.between(least, most)


def provable_tier(score: Column, tier: Column) -> Column:
    """Whether a score lies within the bounds of a numeric tier; false for other tiers than 1 to 5."""
    inside = F.lit(False)
    for t, (low, high) in TIER_BOUNDS.items():
        inside = inside | ((tier == t) & score.between(low, high))
    return inside


def compliant_at_tier(verified_at: Column, expires_at: Column, tier: Column, required: Column, as_of: Column) -> Column:
    """Verified, not expired, and of the required numeric tier or a better (lower) one."""
    return F.coalesce(verified_at.isNotNull() & (as_of <= expires_at) & (tier <= required), F.lit(False))


def credential_state(found: Column, status: Column, expires_at: Column, as_of: Column) -> tuple[Column, Column]:
    """Whether a credential holds, and why not; the first reason counts."""
    message = (
        F.when(~found, "Credential not found").when(status == "revoked", "Credential has been revoked")
        .when(status == "suspended", "Credential is suspended").when(as_of > expires_at, "Credential has expired").otherwise("Credential is valid")
    )
    return message == "Credential is valid", message


def tier_catalogue(tiers: DataFrame) -> DataFrame:
    """A row per capability of each tier of a table (column ``tier``) with the tier's regime; unknown tiers have none."""
    lists = mapped_arrays(F.col("tier"), CAPABILITIES)
    regime = lambda i: mapped(F.col("tier"), {t: r[i] for t, r in TIER_REGIMES.items()})
    return tiers.select(
        *tiers.columns, regime(0).alias("assessment_frequency"), regime(1).alias("evidence"), regime(2).alias("monitoring"),
        F.posexplode(lists).alias("position", "capability"),
    )


def mapped_arrays(key: Column, values: dict[str, tuple[str, ...]]) -> Column:
    out = None
    for k, v in values.items():
        items = F.array(*map(F.lit, v))
        out = F.when(key == k, items) if out is None else out.when(key == k, items)
    return out


def upgrade_triggers(tier: Column, employees: int = 50, revenue: int = 10_000_000, places: int = 3, many: int = 250, rich: int = 50_000_000) -> Column:
    """What would lift an entity of a tier to the next one; nothing lifts the highest."""
    basic = (
        f"Reach {employees}+ employees", f"Exceed ${revenue:,} annual revenue", f"Expand to {places}+ jurisdictions",
        "Enter regulated sector (Finance, Healthcare, etc.)",
    )
    standard = (
        f"Reach {many}+ employees", f"Exceed ${rich:,} annual revenue", "Expand to multiple regulated jurisdictions",
        "Process sensitive personal data", "Become government contractor",
    )
    return F.coalesce(mapped_arrays(tier, {"basic": basic, "standard": standard}), F.array().cast("array<string>"))


def score_percentage(score: Column) -> Column:
    """A score of five as per cent."""
    return score / 5 * 100


def next_due(last: Column, days: int = 365) -> Column:
    return F.date_add(last, days)


def default_due(created: Column, days: int = 30) -> Column:
    return F.date_add(created, days)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys, ", " and ": " between parts, and escapes for all but ASCII (no built-in function writes these)."""
    return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True))


def calldata(proof: Column) -> Column:
    """The eight numbers of a proof (struct of ``pi_a``, ``pi_b``, ``pi_c``) in the order in which contracts take them."""
    a, b, c = proof["pi_a"], proof["pi_b"], proof["pi_c"]
    return F.array(a[0], a[1], b[0][0], b[0][1], b[1][0], b[1][1], c[0], c[1])


def commitment(signals: Column) -> Column:
    """The last public signal; empty without signals."""
    return F.coalesce(F.try_element_at(signals, F.lit(-1)), F.lit(""))


def to_hex(record: Column) -> Column:
    return F.lower(F.hex(F.encode(F.to_json(record), "UTF-8")))


def from_hex(text: Column, schema: str) -> Column:
    return F.from_json(F.decode(F.unhex(text), "UTF-8"), schema)


def celex_type(celex: Column) -> Column:
    """Kind of document that the sixth sign of a CELEX number names; a regulation for all others."""
    return F.coalesce(mapped(F.substring(celex, 6, 1), CELEX_TYPES), F.lit("regulation"))


def metric_unit(name: Column) -> Column:
    return F.when(name.contains("score"), "score").otherwise("count")


def state_id(entity_id: Column, requirement_id: Column) -> Column:
    return F.concat_ws("-", F.lit("CS"), entity_id.cast("string"), requirement_id.cast("string"))


def named(code: Column, names: dict[str, str]) -> Column:
    """Name of a code, the code itself where it has none."""
    return F.coalesce(mapped(code, names), code)


def governance_layer(jurisdiction: Column) -> Column:
    return F.when(jurisdiction == "EU", "regional").otherwise("national")


def known_or(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """The value if it is one of the allowed ones, else the default."""
    return F.when(value.isin(*allowed), value).otherwise(default)


def assessed_rate(compliant: Column, non_compliant: Column, partial: Column) -> Column:
    """Per cent of the assessed that comply, partial ones by half; 0 if none was assessed."""
    assessed = compliant + non_compliant + partial
    return F.when(assessed == 0, 0.0).otherwise((compliant + partial * 0.5) / assessed * 100)
