"""Staged changes: idempotent staging, decisions, and the two publish gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources import commits
from .groups import first_rows, join_keys

DEFAULT_WORKFLOW = "collector_workflow"

# Decision per action.
DECISION_OF_ACTION = {"approve": "approved", "edit_then_approve": "approved", "reject": "rejected"}


def new_changes(existing: DataFrame, batch: DataFrame, by: str = "thread_id", pos: str = "pos") -> DataFrame:
    """Rows of the batch to append: the first of each thread, and only threads
    that are not staged yet, so staging twice changes nothing."""
    first = first_rows(batch, [by], pos, "_first").filter("_first").drop("_first")
    return first.join(existing.select(by), by, "left_anti")


def stage(spark: SparkSession, root: str, batch: DataFrame, by: str = "thread_id", pos: str = "pos") -> int | None:
    """Append the batch to the staged changes under ``root`` as one commit: the first row of each
    thread, and only threads that are not staged. Of writers that stage the same thread at the
    same time the first to commit does, the others drop it. A null thread is a thread."""
    first = first_rows(batch, [by], pos, "_first").filter("_first").drop("_first")
    return commits.append(spark, root, first, lambda staged, rows: join_keys(rows, staged.select(by), [by], "left_anti"))


def staged_changes(spark: SparkSession, root: str) -> DataFrame | None:
    """All staged changes; None before the first commit."""
    return commits.read_rows(spark, root)


def with_workflow(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """Workflow of each change by its run; the collector when there is none."""
    types = runs.select(F.col("id").alias("agent_run_id"), "workflow_type")
    return changes.join(types, "agent_run_id", "left").withColumn(
        "workflow_type", F.coalesce("workflow_type", F.lit(DEFAULT_WORKFLOW))
    )


def latest_decision(decisions: DataFrame, keep: Sequence[str] = ("decision",)) -> DataFrame:
    return decisions.groupBy("proposed_change_id").agg(
        F.max_by(F.struct("id", *keep), F.struct("decided_at", "id")).alias("_l")
    ).select("proposed_change_id", "_l.*")


@dataclass
class Decided:
    changes: DataFrame
    approvals: DataFrame
    audit: DataFrame
    refused: DataFrame


def choose_decisions(changes: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions that count, refused ones with the problem). Of several on one pending change the
    first usable one (by ``seq``) counts and the others meet a change that is no longer pending."""
    action_map = F.create_map(*[F.lit(v) for kv in DECISION_OF_ACTION.items() for v in kv])
    base = decisions.withColumn("decision", F.try_element_at(action_map, F.col("action"))).join(
        changes.select(F.col("id").alias("proposed_change_id"), "status", "thread_id", F.lit(True).alias("_known")),
        "proposed_change_id", "left",
    )
    problem = (
        F.when(F.col("_known").isNull(), "not_found")
        .when(F.col("status") != "pending", "not_pending")
        .when(F.coalesce("thread_id", F.lit("")) == "", "no_thread")
        .when(F.col("decision").isNull(), "unknown_action")
    )
    checked = base.withColumn("problem", problem)
    usable = checked.filter(F.col("problem").isNull()).drop("problem")
    # The decisions of a change are in one task already, where they met it; so they are read once.
    flagged = usable.withColumn("_first", F.col("seq").eqNullSafe(F.min("seq").over(Window.partitionBy("proposed_change_id"))))
    columns = ["proposed_change_id", "seq", "action"]
    applied = flagged.filter("_first").select(*columns, "decision", "edited_structured_json", "reviewer_user_id", "reason", "decided_at")
    refused = (
        checked.filter(F.col("problem").isNotNull()).select(*columns, "problem")
        .unionByName(flagged.filter(~F.col("_first")).select(*columns, F.lit("not_pending").alias("problem")))
    )
    return applied, refused


def apply_decisions(changes: DataFrame, decisions: DataFrame, published: DataFrame | None = None) -> Decided:
    """Decisions on pending changes, see ``choose_decisions``. ``published`` lists change ids
    whose data was written."""
    return with_decisions(changes, *choose_decisions(changes, decisions), published)


def with_decisions(changes: DataFrame, applied: DataFrame, refused: DataFrame, published: DataFrame | None = None) -> Decided:
    """Changes after the decisions that ``choose_decisions`` gave."""
    final = applied.select(
        F.col("proposed_change_id").alias("id"),
        F.col("decision").alias("_decision"),
        F.when(F.col("action") == "edit_then_approve", F.col("edited_structured_json")).alias("_edited"),
    )
    updated = changes.join(final, "id", "left")
    status = F.coalesce("_decision", "status")
    if published is not None:
        updated = updated.join(published.select("id", F.lit(True).alias("_written")), "id", "left")
        status = F.when(F.col("_decision").isNotNull() & F.col("_written"), "published").otherwise(status)
        updated = updated.withColumn("status", status).drop("_written")
    else:
        updated = updated.withColumn("status", status)
    updated = updated.withColumn("structured_json", F.coalesce("_edited", "structured_json")).drop("_decision", "_edited")
    approvals = applied.select("proposed_change_id", "decision", "reviewer_user_id", "reason", "decided_at")
    actions = F.when(
        F.col("action") == "edit_then_approve", F.array(F.lit("proposed_change.edit"), F.lit("proposed_change.approve"))
    ).when(F.col("action") == "approve", F.array(F.lit("proposed_change.approve"))).otherwise(
        F.array(F.lit("proposed_change.reject"))
    )
    audit = applied.select(
        F.explode(actions).alias("action"), F.lit("proposed_change").alias("entity_type"),
        F.col("proposed_change_id").cast("string").alias("entity_id"), F.col("reviewer_user_id").alias("actor_id"),
        F.col("decided_at").alias("created_at"),
    )
    return Decided(updated, approvals, audit, refused)


def _split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter(F.col("refusal").isNull()).drop("refusal"), checked.filter(F.col("refusal").isNotNull())


def _common_refusals(required: Sequence[str]) -> Column:
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    return (
        F.when(F.coalesce(F.col("status"), F.lit("")) != "approved", "not_approved")
        .when(missing, "missing_input")
        .when(F.coalesce("errors", F.lit(0)) > 0, "revalidation_failed")
    )


def _with_taken(changes: DataFrame, published: DataFrame) -> DataFrame:
    """Flag changes whose entity has a published change with another id. The first
    and last id per entity tell, so an entity's changes are never paired."""
    ids = published.groupBy("entity_id").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"))
    joined = changes.join(ids, "entity_id", "left")
    other = (F.col("_lo") != F.col("id")) | (F.col("_hi") != F.col("id"))
    return joined.withColumn("_taken", F.coalesce(other, F.lit(False))).drop("_lo", "_hi")


def collector_gate(
    changes: DataFrame, outcomes: DataFrame, published: DataFrame, order: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(changes that may be published, refused ones with the reason): approved,
    valid when checked again, and no other change published for the entity. With
    ``order``, of several that pass for one entity only the first does."""
    joined = _with_taken(changes.join(outcomes.select("id", "errors"), "id", "left"), published)
    refusal = F.coalesce(_common_refusals(["structured_json", "id"]), F.when(F.col("_taken"), "already_published"))
    good, bad = _split(joined.withColumn("refusal", refusal).drop("_taken"))
    if order is None:
        return good, bad
    ranked = first_rows(good, ["entity_id"], order, "_first")
    late = ranked.filter(~F.col("_first")).withColumn("refusal", F.lit("already_published"))
    return ranked.filter("_first").drop("_first"), bad.unionByName(late.drop("_first"))


def reviewer_gate(changes: DataFrame, outcomes: DataFrame, production: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As the collector's, but the delta must be present and the entity must
    already be live."""
    live = production.select("entity_id").distinct().withColumn("_live", F.lit(True))
    joined = changes.join(outcomes.select("id", "errors"), "id", "left").join(live, "entity_id", "left")
    refusal = F.coalesce(
        _common_refusals(["structured_json", "id", "delta"]), F.when(F.col("_live").isNull(), "not_in_production")
    )
    return _split(joined.withColumn("refusal", refusal).drop("_live"))


def not_published_elsewhere(changes: DataFrame, published: DataFrame) -> DataFrame:
    """Changes whose entity has no published change but their own."""
    return _with_taken(changes, published).filter(~F.col("_taken")).drop("_taken")


def in_production(changes: DataFrame, production: DataFrame) -> DataFrame:
    return changes.join(production.select("entity_id"), "entity_id", "left_semi")
