"""Inserts, upserts, updates and deletes on immutable tables: each returns the new version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``changes`` replace rows of the same key and are added otherwise."""
    return base.join(changes, key, "left_anti").unionByName(changes)


def updated(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Non-null values of ``changes`` overwrite those of the same key; unknown keys are ignored."""
    new = [c for c in changes.columns if c not in key]
    renamed = changes.select(*key, *(F.col(c).alias(f"_new_{c}") for c in new))
    met = base.join(renamed, key, "left")
    return met.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in new else F.col(c) for c in base.columns))


def soft_deleted(base: DataFrame, condition: Column, at: Column) -> DataFrame:
    return base.withColumn("deleted_at", F.when(condition & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at")))


def cascaded(parent: DataFrame, child: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Parent and child tables without the deleted keys."""
    lost = gone.select(F.col(key).alias("_k")).distinct()
    return parent.join(lost, parent[key] == lost._k, "left_anti"), child.join(lost, child[foreign] == lost._k, "left_anti")


#: Steps of the assessment workflow: state, action, next state (fixed values).
TRANSITIONS = (
    ("draft", "start", "in_progress"), ("in_progress", "submit", "pending_review"), ("pending_review", "approve", "completed"),
    ("pending_review", "reject", "rejected"), ("rejected", "reopen", "in_progress"), ("completed", "archive", "archived"),
)


def transitioned(assessments: DataFrame, actions: DataFrame) -> DataFrame:
    """Next status of each (assessment, action) and whether the step is allowed; six rows are broadcast."""
    steps = assessments.sparkSession.createDataFrame(list(TRANSITIONS), "status string, action string, next_status string")
    met = assessments.join(actions, "assessment_id").join(F.broadcast(steps), ["status", "action"], "left")
    return met.withColumn("valid", F.col("next_status").isNotNull())


def inserted(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows added to a table; columns that they do not have are null."""
    return base.unionByName(rows, allowMissingColumns=True)


def merged(base: DataFrame, changes: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table after an upsert, and one row of counters: created, updated and unchanged rows.

    The changes are matched once, by a full outer join on the key; ``changes``
    has all columns of the table and unique keys.
    """
    values = [c for c in base.columns if c not in key]
    new = changes.select(*key, F.struct(*values).alias("_new"), F.lit(True).alias("_is_new"))
    old = base.select(*key, F.struct(*values).alias("_old"), F.lit(True).alias("_is_old"))
    met = old.join(new, key, "full_outer")
    table = met.select(*key, F.when(F.col("_is_new"), F.col("_new")).otherwise(F.col("_old")).alias("_v")).select(*key, *(F.col(f"_v.{c}").alias(c) for c in values))
    same = F.col("_new").eqNullSafe(F.col("_old"))
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    both = F.col("_is_old") & F.col("_is_new")
    counters = met.agg(
        count(F.col("_is_old").isNull(), "created"), count(both & ~same, "updated"), count(both & same, "unchanged"), count(F.col("_is_new").isNull(), "untouched")
    )
    return table.select(*base.columns), counters


def transition_effects(assessments: DataFrame, actions: DataFrame, at: Column) -> DataFrame:
    """Assessments after valid actions, with the times and persons that each kind of action sets.

    ``actions``: assessment_id, action, user.  Starting sets ``started_at``,
    approving ``completed_at`` and ``approver``, rejecting ``reviewer``; invalid
    actions change nothing.
    """
    steps = assessments.sparkSession.createDataFrame(list(TRANSITIONS), "_from string, _action string, _to string")
    met = assessments.join(actions.select("assessment_id", F.col("action").alias("_asked"), F.col("user").alias("_user")), "assessment_id", "left")
    met = met.join(F.broadcast(steps), (met.status == steps._from) & (F.col("_asked") == steps._action), "left")
    done = lambda action: F.col("_action") == action
    sets = {
        "status": F.coalesce("_to", "status"), "started_at": F.when(done("start"), at).otherwise(F.col("started_at")),
        "completed_at": F.when(done("approve"), at).otherwise(F.col("completed_at")), "approver": F.when(done("approve"), F.col("_user")).otherwise(F.col("approver")),
        "reviewer": F.when(done("reject"), F.col("_user")).otherwise(F.col("reviewer")),
        "updated_at": F.when(F.col("_action").isNotNull(), at).otherwise(F.col("updated_at")),
    }
    return met.withColumns(sets).select(*assessments.columns)


def with_overrides(entities: DataFrame, overrides: DataFrame) -> DataFrame:
    """Entities with the tiers that people set by hand; these win over computed ones until they are cleared (null tier).

    ``overrides``: entity_id, tier, reason, at; the latest of an entity counts.
    """
    last = overrides.groupBy("entity_id").agg(F.max_by(F.struct("tier", "reason"), "at").alias("_o"))
    met = entities.join(last, "entity_id", "left")
    by_hand = F.col("_o.tier").isNotNull()
    return met.select(
        *(c for c in entities.columns if c != "tier"), F.coalesce("_o.tier", "tier").alias("tier"), by_hand.alias("tier_override"),
        F.when(by_hand, F.col("_o.reason")).alias("reason"),
    )
