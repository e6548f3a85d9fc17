"""Decide and publish: apply decisions, check again, pass the gates, patch, publish, audit.

A catalog is a dict of tables (restaurants, locations, menus, categories, dishes, or some of
them); every row carries ``entity_id``, the restaurant it belongs to."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.let import let
from ..operators import catalog, conform, delta as deltas, report, review
from ..schema import RESTAURANT, RESTAURANT_RECORD, Record, Rule
from ..session import reliable_checkpoint as fixed
from ..sources import audit, versions

#: What the JSON of a staged change may hold: fields of the restaurant, and of a review
#: the number of its changes. A new name counts on a first publication only.
CHANGE_RECORD = Record((*(r if r.name != "name" else Rule("name", nullable=False, min_len=1, max_len=255, not_blank=True) for r in RESTAURANT_RECORD.fields), Rule("changes", "int")))


@dataclass
class Published:
    changes: DataFrame
    approvals: DataFrame
    refused_decisions: DataFrame
    refused_changes: DataFrame
    published: DataFrame
    tables: dict[str, DataFrame]
    audit: DataFrame
    runs: DataFrame

    @property
    def dishes(self) -> DataFrame:
        return self.tables["dishes"]


def record_errors(changes: DataFrame) -> DataFrame:
    """(id, errors) of changes whose JSON, as staged or as a reviewer edited it, breaks
    the closed record of a restaurant."""
    issues = conform.flat_schema_issues(changes.select("id", "structured_json"), ["id"], "structured_json", CHANGE_RECORD)
    return issues.groupBy("id").agg(F.count(F.lit(1)).alias("errors"))


def revalidation(target: dict[str, DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The check right before publishing: all rules once more on the rows that would be
    published, and the closed record on the changes' JSON with its edits. Gives a function
    from the approved changes to (id, errors). Of ``target`` restaurants and dishes are
    needed; dishes have the columns that the rules read and a ``dish_id``."""

    def check(changes: DataFrame) -> DataFrame:
        entities = changes.select("entity_id").distinct()
        part = {name: rows.join(entities, "entity_id", "left_semi") for name, rows in target.items()}
        dishes = part["dishes"]
        menus = part.get("menus", dishes.select("entity_id").distinct())
        scope = ["entity_id", "menu_pos"]
        outcome = report.run_rules(part["restaurants"], part.get("locations", entities.limit(0)), menus, dishes, "entity_id", "dish_id", scope)
        by_entity = report.outcome_per_record(entities, outcome.issues, ["entity_id"]).select("entity_id", "errors")
        by_rule = changes.select("id", "entity_id").join(by_entity, "entity_id").select("id", "errors")
        return by_rule.unionByName(record_errors(changes)).groupBy("id").agg(F.sum("errors").alias("errors"))

    return check


def with_staged_fields(restaurants: DataFrame, staged: DataFrame) -> DataFrame:
    """Restaurants with the fields that their change's JSON holds; a key that is absent
    leaves the field as it is, a null clears it. ``staged`` has one row an entity."""
    fields = [f for f in RESTAURANT.fields if f.name in restaurants.columns and f.name != "id"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    read = staged.select("entity_id", F.json_object_keys("structured_json").alias("_keys"), F.from_json("structured_json", schema).alias("_new"))
    joined = restaurants.join(read, "entity_id", "left")
    given = lambda c: F.coalesce(F.array_contains("_keys", c), F.lit(False))
    names = {f.name for f in fields}
    return joined.select(*[F.when(given(c), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in names else c for c in restaurants.columns])


def _staged_field_names(staged: DataFrame) -> DataFrame:
    """(entity_id, field) of the profile fields that a review's JSON, once edited, holds."""
    keys = let(F.coalesce(F.json_object_keys("structured_json"), F.array().cast("array<string>")), lambda k: F.array_intersect(k, F.array(*map(F.lit, deltas.PATCH_FIELDS))))
    return staged.select("entity_id", F.explode(keys).alias("field"))


def decide_and_publish(
    changes: DataFrame, decisions: DataFrame, runs: DataFrame, check: DataFrame | Callable[[DataFrame], DataFrame],
    live: dict[str, DataFrame], target: dict[str, DataFrame], delta: DataFrame, keys: list[str], profile_delta: DataFrame | None = None,
    table_deltas: Mapping[str, DataFrame] | None = None, levels: Sequence[catalog.Level] = catalog.LEVELS,
) -> Published:
    """``check`` gives the errors per change (id, errors), or makes them from the approved
    changes with their edits (see ``revalidation``). ``delta`` has the dish rows and
    ``profile_delta`` the restaurant fields (entity_id, field) a review changes, both with
    the ``change_id`` they belong to. ``table_deltas`` are the changes of the tables above the
    dishes (locations, menus, categories), alike; with them a removal takes what is below it (see
    ``catalog.apply_catalog_delta``), and dishes carry the id and the category that ``levels`` names.

    First publications bring all rows of their entity in every table of ``target``; reviews
    touch only the rows and profile fields that their own deltas or an edit name, so
    another pending change of the entity stays pending. Of several reviews of one
    entity that edit its profile, the one with the greatest id counts.

    Decisions, outcomes and deltas are read once: what concerns the approved changes is fixed,
    and all that follows works on it."""
    applied, unused = review.choose_decisions(changes, decisions)
    applied = fixed(applied)
    approved = applied.filter(F.col("decision") == "approved").select(F.col("proposed_change_id").alias("id"))
    decided = review.with_decisions(changes.join(approved, "id", "left_semi"), applied, unused)
    judged = fixed(review.with_workflow(decided.changes, runs).filter(F.col("status") == "approved"))
    outcomes = fixed((check(judged) if callable(check) else check).select("id", "errors").join(judged.select("id"), "id", "left_semi"))
    # Deltas of changes that were not approved touch nothing.
    reviews = judged.filter(F.col("workflow_type") == "reviewer_workflow").select(F.col("id").alias("change_id"))
    asked = lambda d, columns: fixed(d.select("change_id", *columns).join(reviews, "change_id", "left_semi"))
    delta = asked(delta, ["entity_id", *keys, "op"])
    profile_delta = None if profile_delta is None else asked(profile_delta, ["entity_id", "field"])
    table_deltas = {name: asked(lines, [c for c in lines.columns if c != "change_id"]) for name, lines in (table_deltas or {}).items()}
    already = changes.filter(F.col("status") == "published").select("id", "entity_id")
    ids = delta.select(F.col("change_id").alias("id"))
    if profile_delta is not None:
        ids = ids.union(profile_delta.select("change_id"))
    for lines in table_deltas.values():
        ids = ids.union(lines.select("change_id"))
    has_delta = ids.distinct().withColumn("delta", F.lit("given"))
    first, refused_first = review.collector_gate(
        judged.filter(F.col("workflow_type") != "reviewer_workflow"), outcomes, already, order="id"
    )
    patches, refused_patches = review.reviewer_gate(
        judged.filter(F.col("workflow_type") == "reviewer_workflow").join(has_delta, "id", "left"),
        outcomes, live.get("restaurants", live["dishes"]).select("entity_id"),
    )
    columns = ["id", "entity_id", "agent_run_id", "structured_json"]
    first, patches = fixed(first.select(*columns)), fixed(patches.select(*columns))
    replaced = first.select("entity_id")
    published = first.unionByName(patches).select("id", "entity_id", "agent_run_id")

    patched = dict(live)
    own = lambda d: d.join(patches.select(F.col("id").alias("change_id")), "change_id", "left_semi").drop("change_id")
    if table_deltas:
        named = {name: own(lines) for name, lines in table_deltas.items()} | {"dishes": own(delta)}
        patched |= catalog.apply_catalog_delta(live, target, named, catalog.with_keys(levels, "dishes", keys)).tables
    else:
        patched["dishes"] = deltas.patch_rows(live["dishes"], target["dishes"], own(delta), ["entity_id", *keys])
    put = dict(target)
    if "restaurants" in target:
        last = patches.groupBy("entity_id").agg(F.max_by("structured_json", "id").alias("structured_json"))
        fields = _staged_field_names(last)
        if profile_delta is not None:
            fields = fields.union(own(profile_delta).select("entity_id", "field"))
        edited = with_staged_fields(target["restaurants"], last)
        patched["restaurants"] = deltas.patch_fields(live["restaurants"], edited, fields.distinct(), ["entity_id"])
        put["restaurants"] = with_staged_fields(target["restaurants"], first)
    tables = {
        name: patched[name].join(replaced, "entity_id", "left_anti").unionByName(put[name].join(replaced, "entity_id", "left_semi"))
        for name in target
    }

    final = review.with_decisions(changes, applied, unused, published)
    publish_events = published.select(
        F.lit("proposed_change.publish").alias("action"), F.lit("proposed_change").alias("entity_type"),
        F.col("id").cast("string").alias("entity_id"), F.lit(None).cast("string").alias("actor_id"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )
    events = final.audit.withColumn("created_at", F.col("created_at").cast("timestamp")).unionByName(publish_events)
    refused = refused_first.select("id", "entity_id", "agent_run_id", "refusal").unionByName(refused_patches.select("id", "entity_id", "agent_run_id", "refusal"))
    ended = published.select("agent_run_id", "id", F.lit("succeeded").alias("status"), F.lit(None).cast("string").alias("error_message")).unionByName(
        refused.select("agent_run_id", "id", F.lit("failed").alias("status"), F.col("refusal").alias("error_message"))
    )
    return Published(
        final.changes, final.approvals, final.refused, refused.drop("agent_run_id"), published.drop("agent_run_id"),
        tables, audit.audit_rows(events), ended.filter(F.col("agent_run_id").isNotNull()),
    )


def write(spark: SparkSession, result: Published, root: str, audit_path: str, base: int | None = None) -> int:
    """Publish the new version, then append the audit entries. ``base`` is the version whose
    tables went into the result; if another one was published since, nothing is written."""
    version = versions.publish(spark, root, {**result.tables, "changes": result.changes, "approvals": result.approvals}, base)
    audit.append_audit(result.audit.withColumn("created_at", F.coalesce("created_at", F.current_timestamp())), audit_path)
    return version
