"""Scores, risk levels, tiers and bands as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regatta.functions.numbers import ratio, whole
from regatta.sources.domain import mapped


@dataclass(frozen=True)
class Weights:
    """Weights of tiers, statuses and risk impacts (fixed values of the scoring rules)."""

    tier: dict[str, float] = field(default_factory=lambda: {"basic": 1.0, "standard": 1.5, "advanced": 2.0})
    status: dict[str, float] = field(
        default_factory=lambda: {"compliant": 1.0, "partial": 0.5, "remediation": 0.3, "non_compliant": 0.0, "pending": 0.0}
    )
    risk: dict[str, float] = field(default_factory=lambda: {"low": 1.0, "medium": 1.2, "high": 1.5, "critical": 2.0})


def looked_up(key: Column, values: dict[str, float], default: float) -> Column:
    """A weight by name, ``default`` for unknown names and nulls."""
    return F.coalesce(mapped(key, values), F.lit(default))


def clamped(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def item_scores(items: DataFrame, *keys: str, weights: Weights = Weights()) -> DataFrame:
    """Simple, tier-weighted and risk-adjusted score of each group of items.

    Not-applicable items are left out; a group of nothing else has no row.
    A null risk impact weighs 1, a null or unknown tier 1.
    """
    rated = items.where("status <> 'not_applicable'")
    s = looked_up(F.col("status"), weights.status, 0.0)
    t, r = looked_up(F.col("tier"), weights.tier, 1.0), looked_up(F.col("risk_impact"), weights.risk, 1.0)
    n = F.count("*")
    compliant, partial = F.count(F.when(F.col("status") == "compliant", 1)), F.count(F.when(F.col("status") == "partial", 1))
    bad = F.count(F.when(F.col("status") == "non_compliant", 1))
    out = rated.groupBy(*keys).agg(
        n.alias("total"), compliant.alias("compliant"), bad.alias("non_compliant"),
        F.round(clamped((compliant + 0.5 * partial) / n), 6).alias("simple_score"),
        F.round(F.sum(t * s) / F.sum(t), 6).alias("weighted_score"), F.round(F.sum(r * s) / F.sum(r), 6).alias("risk_adjusted_score"),
    )
    return out.withColumn("risk_level", risk_level(F.col("simple_score"), F.col("non_compliant") / F.col("total")))


def risk_level(score: Column, bad_rate: Column) -> Column:
    return (
        F.when((score < 0.5) | (bad_rate > 0.3), "critical").when((score < 0.7) | (bad_rate > 0.2), "high")
        .when((score < 0.85) | (bad_rate > 0.1), "medium").otherwise("low")
    )


def history(scores: DataFrame, key: str, at: str, score: str, tie: str) -> DataFrame:
    """Previous score, change, change in percent and trend (steps within 0.01 are stable).

    Scores have six digits; differences are taken in millionths.
    """
    w = Window.partitionBy(key).orderBy(at, tie)
    before, now = F.lag(score).over(w), whole(F.col(score), 6)
    step = F.col("_step")
    out = scores.withColumn("previous", before).withColumn("_step", now - whole(F.col("previous"), 6))
    trend = F.when(step > 10_000, "improving").when(step < -10_000, "declining").otherwise("stable")
    pct = F.when(F.col("previous") > 0, ratio(step * 100, whole(F.col("previous"), 6), 4))
    return out.withColumns({"change": step / 1e6, "change_pct": pct, "trend": trend}).drop("_step")


def recency_weighted(scores: DataFrame, key: str, at: str, score: str, tie: str, latest: int = 10) -> DataFrame:
    """Mean of the latest scores of each key, the n-th latest weighing 1 / n."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    rows = scores.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= latest)
    mean = F.sum(F.col(score) / F.col("_n")) / F.sum(1.0 / F.col("_n"))
    return rows.groupBy(key).agg(F.round(mean, 6).alias("recent_score"), F.count("*").alias("n"))


#: Least score, in ten-thousandths, of each tier but the last (fixed values).
ZK_TIERS = ((9500, 1), (8500, 2), (7000, 3), (5000, 4))


def zk_tier(score: Column) -> Column:
    """Tier 1 to 5 of a score in ten-thousandths."""
    out = None
    for least, tier in ZK_TIERS:
        out = F.when(score >= least, tier) if out is None else out.when(score >= least, tier)
    return out.otherwise(len(ZK_TIERS) + 1)


@dataclass(frozen=True)
class TierCriteria:
    """Thresholds and code lists for the recommendation of a tier (defaults are the rules' fixed values)."""

    large_employees: int = 250
    medium_employees: int = 50
    large_revenue: float = 50_000_000
    medium_revenue: float = 10_000_000
    advanced_sectors: tuple[str, ...] = (
        "FINANCE", "BANKING", "INSURANCE", "HEALTHCARE", "PHARMACEUTICALS", "DEFENSE", "GOVERNMENT", "CRITICAL_INFRASTRUCTURE", "ENERGY", "NUCLEAR",
    )
    standard_sectors: tuple[str, ...] = ("TECHNOLOGY", "TELECOMMUNICATIONS", "MANUFACTURING", "TRANSPORT", "LOGISTICS", "RETAIL", "REAL_ESTATE")
    advanced_jurisdictions: tuple[str, ...] = ("US", "EU", "UK", "SG", "HK")
    many_jurisdictions: int = 3
    risk_factors: dict[str, int] = field(
        default_factory=lambda: {
            "processes_personal_data": 1, "processes_sensitive_data": 2, "cross_border_transfers": 1, "government_contractor": 2,
            "publicly_traded": 1, "critical_infrastructure": 2, "handles_minors_data": 2, "automated_decision_making": 1,
        }
    )


def recommended_tier(entities: DataFrame, c: TierCriteria = TierCriteria()) -> DataFrame:
    """Points for each tier from size, sector, jurisdictions, type and risk factors; most points win, ties go to the lower tier.

    A map column ``risk_factors`` (name to boolean) and a size category
    ``size`` are used where the table has them; an empty or null map adds nothing.  Adds ``tier``, ``confidence``,
    ``risk`` (of ten) and ``risk_level``.  All column expressions, no
    user-defined function.
    """
    staff, money = F.col("employee_count"), F.col("annual_revenue")
    by_staff = F.when(staff >= c.large_employees, 3).when(staff >= c.medium_employees, 2).otherwise(1)
    by_money = F.when(money >= c.large_revenue, 3).when(money >= c.medium_revenue, 2).otherwise(1)
    size = F.greatest(by_staff, by_money)
    if "size" in entities.columns:  # the category counts where neither number is known
        category = F.lower("size")
        by_name = F.when(category == "large", 3).when(category == "medium", 2).otherwise(1)
        size = F.when(staff.isNull() & money.isNull(), by_name).otherwise(size)
    upper = lambda name: F.array_distinct(F.transform(F.col(name), F.upper))
    hits = lambda name, codes: F.size(F.array_intersect(upper(name), F.array(*map(F.lit, codes))))
    has = lambda name: F.coalesce(F.size(name) > 0, F.lit(False))
    in_advanced, in_standard = hits("sectors", c.advanced_sectors), hits("sectors", c.standard_sectors)
    sector = F.when(~has("sectors"), 1).when(in_advanced > 0, 3).when(in_standard > 0, 2).otherwise(1)
    sector_risk = F.when(~has("sectors"), 0.0).when(in_advanced > 0, 3.0).when(in_standard > 0, 1.5).otherwise(0.5)
    regulated, places = hits("jurisdictions", c.advanced_jurisdictions), F.size(upper("jurisdictions"))
    geo = F.when(~has("jurisdictions"), 1).when(regulated >= 2, 3).when((places >= c.many_jurisdictions) | (regulated == 1), 2).otherwise(1)
    geo_risk = (
        F.when(~has("jurisdictions"), 0.0).when(regulated >= 2, 2.5).when(places >= c.many_jurisdictions, 1.5).when(regulated == 1, 1.0).otherwise(0.5)
    )
    kind = F.lower("entity_type")
    type_ = F.when(kind == "government", 3).when(kind.isin("corporation", "subsidiary"), 2).otherwise(1)
    factors = [(size, 2), (sector, 3), (geo, 2), (type_, 1)]
    risk = F.when(size == 3, 2.0).otherwise(0.0) + sector_risk + geo_risk
    if "risk_factors" in entities.columns:
        given = F.coalesce(F.size("risk_factors") > 0, F.lit(False))
        active = lambda name: F.coalesce(F.col("risk_factors")[name], F.lit(False))
        weight = sum((F.when(active(name), w).otherwise(0) for name, w in c.risk_factors.items()), F.lit(0))
        factors.append((F.when(given, F.when(weight >= 4, 3).when(weight >= 2, 2).otherwise(1)), 2))
        risk = risk + F.when(given, weight.cast("double")).otherwise(0.0)
    points = [sum((F.when(f == k, w).otherwise(0) for f, w in factors), F.lit(0)) for k in (1, 2, 3)]
    out = entities.withColumns({"_p1": points[0], "_p2": points[1], "_p3": points[2], "_risk": risk})
    p1, p2, p3 = F.col("_p1"), F.col("_p2"), F.col("_p3")
    top = F.greatest(p1, p2, p3)
    second = F.element_at(F.sort_array(F.array(p1, p2, p3)), 2)
    tier = F.when(p1 == top, "basic").when(p2 == top, "standard").otherwise("advanced")
    return out.select(
        *entities.columns, tier.alias("tier"),
        F.round(0.5 + 0.5 * (top - second) / top, 2).alias("confidence"), F.col("_risk").alias("risk"),
        F.when(F.col("_risk") >= 7, "critical").when(F.col("_risk") >= 5, "high").when(F.col("_risk") >= 2.5, "medium").otherwise("low").alias("risk_level"),
    )


def yearly_cost(tier: Column, requirements: Column) -> Column:
    base = mapped(tier, {"basic": 5000, "standard": 25000, "advanced": 100000})
    return base + requirements * mapped(tier, {"basic": 50, "standard": 150, "advanced": 400})


def finalised(assessments: DataFrame, items: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """What approvals make final: completed assessments with their scores; the overall one is the simple one, rounded to four digits.

    ``items``: assessment_id, status, tier, risk_impact.  Only items of
    completed assessments are scored; an assessment without any that applies
    has the overall score 0.
    """
    done = assessments.where("status = 'completed'")
    own = items.join(done.select("assessment_id"), "assessment_id", "left_semi")
    met = done.join(item_scores(own, "assessment_id", weights=weights), "assessment_id", "left")
    return met.withColumns({"overall_score": F.round(F.coalesce("simple_score", F.lit(0.0)), 4), "total": F.coalesce("total", F.lit(0).cast("bigint"))})


def last_assessments(final: DataFrame) -> DataFrame:
    """Each entity's last final assessment, by time and id: entity_id, last_assessment_id, last_assessment_at, compliance_score."""
    last = F.struct("completed_at", "assessment_id")
    return final.groupBy("entity_id").agg(
        F.max_by("assessment_id", last).alias("last_assessment_id"), F.max("completed_at").alias("last_assessment_at"), F.max_by("overall_score", last).alias("compliance_score")
    )


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """The rows with their ``place`` from 1 in the order of ``key``, counted by ranges, so that no task sorts them all."""
    from regatta.operators.scan import chunked

    placed = chunked(rows, F.lit("").alias("_key"), [F.col(key)])
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    starts = sizes.select("_part", before)  # a row a range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return placed.join(F.broadcast(starts), "_part").withColumn("place", inside + F.col("_before")).select(*rows.columns, "place")
