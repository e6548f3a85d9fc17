"""Review: find live restaurants whose page changed, re-extract, diff, stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import uuid5_url
from ..session import reliable_checkpoint as fixed
from ..operators import authority, delta, mapping, report, review, workqueue
from .collect import Extractor, captured_pages, extract_dishes, extract_profiles, material

NATURAL_KEY = ["restaurant_id", "menu_name", "category_name", "name_key", "occurrence"]
DIFF_FIELDS = ["name", "description", "image_url", "nutrition", "allergens", "ingredients", "quantity", "price", "currency"]


@dataclass
class Reviewed:
    due: DataFrame
    gate: DataFrame
    target: DataFrame
    delta: DataFrame
    reports: DataFrame
    staged: DataFrame
    errors: DataFrame
    #: Changed profile fields with the change they belong to; None without a profile extractor.
    profile_delta: DataFrame | None = None


def keyed(dishes: DataFrame) -> DataFrame:
    """Dishes under their natural key; equal names are told apart by position."""
    return delta.with_natural_key(dishes, ["restaurant_id", "menu_name", "category_name"], ["pos", "dish_id"])


def review_sweep(
    live: DataFrame, live_dishes: DataFrame, sources: DataFrame, hints: DataFrame, snapshots: DataFrame,
    running: DataFrame, pages: DataFrame, existing_changes: DataFrame, extractor: Extractor,
    profile_extractor: mapping.Call | None = None,
) -> Reviewed:
    """``live`` are published restaurants (restaurant_id, and nutrition_url if known),
    ``snapshots`` earlier captures per restaurant (source_id, id, fetched_at, content_type,
    content_hash, and page_url if linked pages were kept too; without it a row is of the
    root page), ``pages`` fresh captures (url, html, fetched_at). Root, linked and nutrition
    pages are read just as when the restaurant was collected. The hash gate is a filter
    before the extractor, so restaurants none of whose pages changed never reach Python.

    With a ``profile_extractor`` the profile is read again too and ``live`` has the profile fields; what
    differs is the ``profile_delta``, and the new values are in the staged JSON, from which
    publishing takes them. An empty value never replaces a filled one."""
    due = workqueue.due_entities(live, running)
    current = fixed(authority.current_source(due, sources, hints))
    no_source = current.filter(F.col("url").isNull()).select(
        "restaurant_id", F.lit("temporal_hash_polling").alias("stage"), F.lit("no verified active source found").alias("error_message")
    )
    nutrition = live.select("restaurant_id", "nutrition_url" if "nutrition_url" in live.columns else F.lit(None).cast("string").alias("nutrition_url"))
    sites = current.filter(F.col("url").isNotNull()).select("restaurant_id", F.col("url").alias("resolved_url")).join(nutrition, "restaurant_id", "left")
    read = material(sites, captured_pages(pages))
    failed = read.no_page.select(
        "restaurant_id", F.lit("temporal_hash_polling").alias("stage"), F.concat(F.lit("failed to re-fetch "), "resolved_url").alias("error_message")
    )
    hashes = fixed(read.captured.select("restaurant_id", "rank", "page_url", F.sha2("html", 256).alias("content_hash")))
    by_page = "page_url" in snapshots.columns
    place = ["restaurant_id", "known_page"]
    known = authority.latest_snapshot(snapshots.withColumn("source_id", F.struct("source_id", F.col("page_url") if by_page else F.lit(None).cast("string").alias("page_url"))))
    known = known.select(F.col("source_id.source_id").alias("restaurant_id"), F.coalesce("source_id.page_url", F.lit("")).alias("known_page"), F.col("content_hash").alias("previous_hash"))
    # The root page is known under its address or, where none was kept, as the root.
    root_hashes = known.withColumnsRenamed({"previous_hash": "root_hash"}).filter("known_page = ''").drop("known_page")
    compared = hashes.withColumn("known_page", F.col("page_url")).join(known, place, "left").join(root_hashes, "restaurant_id", "left")
    previous = F.coalesce("previous_hash", F.when(F.col("rank") == 0, F.col("root_hash")))
    other = ~F.col("content_hash").eqNullSafe(previous) & ((F.col("rank") == 0) | F.lit(by_page))
    at_root = lambda c: F.max(F.when(F.col("rank") == 0, c))
    gate = compared.groupBy("restaurant_id").agg(
        at_root(previous).alias("previous_hash"), at_root(F.col("content_hash")).alias("content_hash"), F.bool_or(other).alias("changed"),
        # At most a root, ten links and a nutrition page.
        F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "page_url", "content_hash"))), "\n"), 256).alias("material_hash"),
    )
    verdicts = fixed(gate)
    documents = read.documents.join(verdicts.filter("changed").select("restaurant_id"), "restaurant_id", "left_semi")
    extraction = extract_dishes(documents, extractor)
    failures, issues, profiles = extraction.failures, extraction.issues.select("restaurant_id", "field_path", "message"), None
    if profile_extractor is not None:
        profiles, profile_issues, lost = extract_profiles(documents, profile_extractor)
        profiles = fixed(profiles)
        failures, issues = failures.unionByName(lost), issues.unionByName(profile_issues.select(*issues.columns))
    unread = failures.select(
        "restaurant_id", F.lit("targeted_reextraction").alias("stage"), F.concat(F.lit("extraction call failed: "), "message").alias("error_message")
    )
    # A restaurant of which a call failed keeps all it has, and is not staged.
    checked = fixed(verdicts.filter("changed").select("restaurant_id").join(unread, "restaurant_id", "left_anti"))
    fresh = extraction.dishes
    live_of_checked = live_dishes.join(checked, "restaurant_id", "left_semi")
    # An entity for which nothing was extracted keeps its live menus.
    columns = [c for c in live_of_checked.columns if c in fresh.columns]
    target_rows = mapping.merge_menus(live_of_checked.select(*columns), fresh.select(*columns))
    outcome = report.run_rules(checked, checked.limit(0), target_rows.select("restaurant_id").distinct(), target_rows)
    target = fixed(keyed(outcome.dishes))
    changes = fixed(delta.table_diff(keyed(live_of_checked.select(*columns)), target, NATURAL_KEY, DIFF_FIELDS))
    refs = keyed(fresh).select(*NATURAL_KEY, "source_snapshot_ids")
    no_profile = checked.limit(0).withColumn("source_snapshot_ids", F.array().cast("array<string>"))
    traced = delta.with_provenance(changes, refs, no_profile, NATURAL_KEY, "restaurant_id")
    touched = delta.touched_keys(changes, NATURAL_KEY).join(target.select(*NATURAL_KEY, "dish_id"), NATURAL_KEY).select("restaurant_id", "dish_id")
    reports = delta.scoped_report(checked, outcome.issues, touched, "restaurant_id", ["restaurant_id", "dish_id"])
    sizes = changes.groupBy("restaurant_id").agg(F.count(F.lit(1)).alias("changes"))
    change_id = uuid5_url(F.concat_ws(":", F.lit("review"), "restaurant_id", "material_hash"))
    number, staged_fields, profile_delta = F.coalesce("changes", F.lit(0)), [], None
    if profiles is not None:
        shown = live.join(checked, "restaurant_id", "left_semi").select("restaurant_id", *delta.PROFILE_FIELDS)
        renewed = mapping.merge_profiles(shown, profiles)
        lines = fixed(delta.table_diff(shown, renewed, ["restaurant_id"], delta.PROFILE_FIELDS))
        told = delta.with_provenance(lines, no_profile, profiles.select("restaurant_id", "source_snapshot_ids"), ["restaurant_id"], "restaurant_id")
        profile_delta = told.join(verdicts.select("restaurant_id", "material_hash"), "restaurant_id").withColumn("change_id", change_id).drop("material_hash")
        # One row a restaurant: the fields that changed with their new values, others null and so not in the JSON.
        names = lines.groupBy("restaurant_id").agg(F.collect_set("field").alias("_fields"))
        values = renewed.join(names, "restaurant_id").select(
            "restaurant_id", F.size("_fields").alias("_profile_changes"),
            *[F.when(F.array_contains("_fields", f), F.col(f)).alias(f) for f in delta.PROFILE_FIELDS],
        )
        judged = reports.join(values, "restaurant_id", "left")
        number, staged_fields = number + F.coalesce("_profile_changes", F.lit(0)), list(delta.PROFILE_FIELDS)
    else:
        judged = reports
    batch = (
        judged.join(sizes, "restaurant_id", "left").join(verdicts.select("restaurant_id", "material_hash"), "restaurant_id")
        .select(
            change_id.alias("id"),
            F.lit("restaurant").alias("entity_type"),
            F.col("restaurant_id").alias("entity_id"),
            F.to_json(F.struct(number.alias("changes"), *staged_fields)).alias("structured_json"),
            F.to_json(F.struct("is_valid", "errors", "warnings", "reported_issues")).alias("validation_result"),
            F.lit("pending").alias("status"),
            F.concat_ws(":", F.lit("review"), "restaurant_id", "material_hash").alias("thread_id"),
            F.lit(0).cast("long").alias("pos"),
        )
    )
    bad_rows = issues.select(
        "restaurant_id", F.lit("targeted_reextraction").alias("stage"), F.concat_ws(" ", "field_path", "message").alias("error_message")
    )
    return Reviewed(
        due, verdicts, target, traced, reports,
        review.new_changes(existing_changes, batch).drop("pos"), no_source.unionByName(failed).unionByName(unread).unionByName(bad_rows),
        profile_delta,
    )
