"""Append-only audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ids import uuid5_url
from ..schema import AUDIT_ENTRY

# Audited actions and entity types.
ACTIONS = (
    "restaurant.create",
    "restaurant.edit",
    "restaurant.delete",
    "ai.extraction",
    "agent_run.trigger",
    "proposed_change.create",
    "proposed_change.edit",
    "proposed_change.approve",
    "proposed_change.reject",
    "proposed_change.publish",
    "security.login_success",
    "security.login_failure",
    "security.logout",
    "security.logout_all",
    "security.token_refresh",
)
ENTITY_TYPES = ("restaurant", "proposed_change", "agent_run", "user", "session")


def audit_rows(events: DataFrame, actors: DataFrame | None = None) -> DataFrame:
    """Complete audit entries. Missing columns are null; struct or map columns of
    old values, new values and metadata become JSON; the actor's e-mail is copied
    in, so the entry outlives the account."""
    rows = events
    if actors is not None:
        rows = rows.join(actors.select("actor_id", "actor_email"), "actor_id", "left")
    for f in AUDIT_ENTRY.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    kinds = dict(rows.dtypes)

    def as_json(c: str) -> Column:
        return F.to_json(c) if kinds[c].startswith(("struct", "map", "array")) else F.col(c).cast("string")

    for c in ("old_values", "new_values", "metadata"):
        rows = rows.withColumn(c, as_json(c))
    identity = F.concat_ws(
        ":", F.lit("audit"), "action", F.coalesce("entity_id", F.lit("")), F.coalesce("actor_id", F.lit("")),
        F.col("created_at").cast("string"), F.coalesce("new_values", F.lit("")), F.coalesce("metadata", F.lit("")),
    )
    rows = rows.withColumn("id", F.coalesce("id", uuid5_url(identity)))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in AUDIT_ENTRY.fields])


def unknown_entries(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("action").isin(*ACTIONS) | ~F.col("entity_type").isin(*ENTITY_TYPES))


def append_audit(rows: DataFrame, path: str) -> None:
    """Entries are only ever added; days are partitions, so recent ones are found
    without reading the rest. Rows are gathered by day, large days over several tasks."""
    rows.withColumn("day", F.to_date("created_at")).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
