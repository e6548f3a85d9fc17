"""Collect: uploads and captured pages to staged, checked catalog rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.ids import uuid5_url
from ..functions.text import batch_name_key
from ..functions.urls import canonical_url, domain_of
from ..operators import authority, groups, mapping, pages as pg, report, review, workqueue
from ..operators.conform import gate
from ..session import reliable_checkpoint as fixed
from ..schema import EXTRACTED_DISH, EXTRACTED_DISH_RECORD, EXTRACTED_PROFILE, EXTRACTED_PROFILE_RECORD, Record, Rule
from ..sources import audit, snapshots as snap
from ..sources.upload import upload_items

SEED_PREFIX = "restaurant-seed:"
# No limit where links are only listed.
ALL_LINKS = 2**31 - 1
DISH_KEYS = ["restaurant_id", "stub_pos", "pos"]
STUB_FIELDS = (
    Rule("menu_name", required=True, nullable=False, min_len=1, max_len=255),
    Rule("category_name", required=True, nullable=False, min_len=1, max_len=255),
)
EXTRACTION_RECORD = Record((*STUB_FIELDS, *EXTRACTED_DISH_RECORD.fields))
EXTRACTION_SCHEMA = T.StructType(
    [
        T.StructField("restaurant_id", T.StringType()),
        T.StructField("stub_pos", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("menu_name", T.StringType()),
        T.StructField("category_name", T.StringType()),
        *[f for f in EXTRACTED_DISH.fields if f.name not in ("run_id", "stub_pos", "pos")],
    ]
)
PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("restaurant_id", T.StringType()), T.StructField("pos", T.IntegerType()),
        *[f for f in EXTRACTED_PROFILE.fields if f.name != "run_id"],
    ]
)
PROFILE_FIELDS = ("description", "cuisine_types", "logo_url", "cover_image_url")
Extractor = Callable[[pd.DataFrame], pd.DataFrame] | mapping.TwoPhase


@dataclass
class Extraction:
    dishes: DataFrame
    issues: DataFrame
    failures: DataFrame


@dataclass
class Collected:
    queue: DataFrame
    resolved: DataFrame
    sources: DataFrame
    snapshots: DataFrame
    links: DataFrame
    dishes: DataFrame
    issues: DataFrame
    corrections: DataFrame
    outcomes: DataFrame
    staged: DataFrame
    errors: DataFrame
    to_render: DataFrame
    runs: DataFrame
    audit: DataFrame


def captured_pages(pages: DataFrame) -> DataFrame:
    """The newest capture (page_url, html, fetched_at, kind) of each canonical URL, of equal
    ones the one whose digest is first. It is chosen on small columns; page bodies are
    not aggregated. ``kind`` is html or pdf by the header ``content_type``; with
    ``http_status``, ``server`` and ``mitigated`` challenge pages are told: they never stand
    before another capture, and alone they have no body and the kind challenge. All four
    columns are optional."""
    given = lambda c, kind: F.col(c).cast(kind) if c in pages.columns else F.lit(None).cast(kind)
    blocked = pg.is_challenge_page(given("http_status", "int"), given("server", "string"), given("mitigated", "string"), F.col("html").cast("string"))
    known = pages.select(
        canonical_url(F.col("url"))["url"].alias("page_url"), "url", "html", "fetched_at",
        F.coalesce(pg.content_type(given("content_type", "string")), F.lit("html")).alias("kind"), (~blocked).alias("_real"), F.sha2("html", 256).alias("_hash"),
    ).filter(F.col("page_url").isNotNull())
    place = ["_real", "fetched_at", "url", "_hash"]
    newest = known.groupBy("page_url").agg(F.max(F.struct(*place)).alias("_n")).select("page_url", "_n.*")
    chosen = known.join(newest, ["page_url", *place], "left_semi")
    # What repeats in every column is one capture.
    return chosen.dropDuplicates(["page_url"]).select(
        "page_url", F.when(F.col("_real"), F.col("html")).alias("html"), "fetched_at", F.when(F.col("_real"), F.col("kind")).otherwise("challenge").alias("kind")
    )


@dataclass
class Material:
    """What there is to read of each restaurant: captured pages, links, documents."""

    captured: DataFrame
    links: DataFrame
    lost_links: DataFrame
    documents: DataFrame
    no_page: DataFrame
    to_render: DataFrame


def material(sites: DataFrame, stored: DataFrame) -> Material:
    """Root page first, then the linked pages in page order, then the nutrition page, as
    far as they were captured and lie in the verified domain. ``sites`` has restaurant_id,
    resolved_url and nutrition_url. Collecting and reviewing read by this one function,
    so a review compares like with like. Links beyond the limit of a page are told. Only
    html is read for links and texts; other kinds are captured all the same. ``to_render``
    lists root pages so thin that a browser should capture them again."""
    text = F.make_valid_utf8(F.col("html").cast("string")) if dict(stored.dtypes)["html"] == "binary" else F.col("html")
    roots = sites.join(stored, F.col("resolved_url") == F.col("page_url"), "left").withColumn("domain", domain_of(F.col("resolved_url")))
    with_page, no_page = gate(roots, "extraction", ["html"])
    no_page = no_page.withColumn(
        "error_message", F.when(F.col("kind") == "challenge", F.concat(F.lit("only a challenge page was captured of "), "resolved_url")).otherwise(F.col("error_message"))
    )
    root_html = with_page.filter(F.col("kind") == "html").withColumn("html", text)
    to_render = root_html.filter(pg.is_thin_page(F.col("kind"), F.col("html"))).select("restaurant_id", "resolved_url")
    parsed = pg.parse_pages(root_html, ["restaurant_id", "domain"], "resolved_url", "html")
    every = fixed(pg.discover_links(parsed, ["restaurant_id"], "domain", limit=ALL_LINKS))
    links = every.filter(F.col("rank") < pg.LINKS_PER_PAGE)
    crawled = fixed(with_page.select("restaurant_id", "resolved_url", "domain", canonical_url(F.col("nutrition_url"))["url"].alias("nutrition")))
    wanted = (
        crawled.select("restaurant_id", F.lit(0).alias("rank"), F.col("resolved_url").alias("page_url"))
        .unionByName(links.select("restaurant_id", (F.col("rank") + 1).alias("rank"), canonical_url(F.col("absolute_url"))["url"].alias("page_url")))
        .unionByName(
            crawled.filter(F.col("nutrition").isNotNull() & pg.is_inside_domain(F.col("nutrition"), F.col("domain")))
            .select("restaurant_id", F.lit(pg.LINKS_PER_PAGE + 1).alias("rank"), F.col("nutrition").alias("page_url"))
        )
        .groupBy("restaurant_id", "page_url").agg(F.min("rank").alias("rank"))
    )
    captured = fixed(wanted).join(stored.filter(F.col("html").isNotNull()), "page_url")
    readable = captured.filter(F.col("kind") == "html").withColumn("snapshot", F.sha2("html", 256)).withColumn("html", text)
    documents = mapping.assemble_documents(readable, "restaurant_id", "rank", "snapshot", "html")
    return Material(captured, links, every.filter(F.col("rank") >= pg.LINKS_PER_PAGE), documents, no_page, to_render)


def extract_dishes(documents: DataFrame, extractor: Extractor) -> Extraction:
    """Run the extractor, in one call per document or in two phases, refuse rows outside the
    closed schema, and give every dish its menu and category index, path label and stable
    id. A restaurant of which a call failed has no dishes, but a row in ``failures``."""
    run = mapping.extract_by_category if isinstance(extractor, mapping.TwoPhase) else mapping.extract
    extracted = run(documents, extractor, EXTRACTION_SCHEMA, DISH_KEYS, EXTRACTION_RECORD)
    rows, issues = extracted.rows, extracted.issues
    stubs = rows.groupBy("restaurant_id", "menu_name", "category_name").agg(F.min("stub_pos").alias("pos"))
    ordered = mapping.menus_in_first_seen_order(stubs, "restaurant_id")
    menus = groups.number_rows(
        ordered.select("restaurant_id", "menu_name", "menu_order").distinct(), ["restaurant_id"], ["menu_order", "menu_name"], "_m"
    )
    categories = groups.number_rows(
        ordered.join(menus.drop("menu_order"), ["restaurant_id", "menu_name"]),
        ["restaurant_id", "menu_name"], ["category_order", "category_name"], "_c",
    ).select("restaurant_id", "menu_name", "category_name", (F.col("_m") - 1).alias("menu_pos"), (F.col("_c") - 1).alias("category_pos"))
    placed = fixed(rows.join(categories, ["restaurant_id", "menu_name", "category_name"]))
    category_key = uuid5_url(F.concat_ws(":", F.lit("category"), "restaurant_id", "menu_name", "category_name"))
    mapped = mapping.map_dishes(
        placed, category_key, ["restaurant_id", "menu_name", "category_name", "stub_pos", "pos", "name"],
        keep=["source_snapshot_ids", "menu_pos", "category_pos"],
    )
    dishes = (
        mapped.withColumnRenamed("id", "dish_id")
        .withColumn(
            "path",
            F.concat(
                F.lit("menus["), F.col("menu_pos"), F.lit("].categories["), F.col("category_pos"),
                F.lit("].dishes["), F.col("pos"), F.lit("]"),
            ),
        )
    )
    return Extraction(dishes, issues, extracted.failures)


def extract_profiles(documents: DataFrame, extractor: mapping.Call) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, issues, failures): one row per restaurant with the profile fields, of each the first
    non-empty value in the order of the material, and all snapshots they were read from."""
    extracted = mapping.extract(documents, extractor, PROFILE_SCHEMA, ["restaurant_id", "pos"], EXTRACTED_PROFILE_RECORD)
    rows = extracted.rows

    def first(name: str):
        filled = (F.size(name) > 0) if name == "cuisine_types" else (F.length(name) > 0)
        return F.min_by(name, F.when(filled, F.col("pos"))).alias(name)

    merged = rows.groupBy("restaurant_id").agg(*map(first, PROFILE_FIELDS))
    refs = rows.select("restaurant_id", F.explode("source_snapshot_ids").alias("_s")).groupBy("restaurant_id").agg(F.sort_array(F.collect_set("_s")).alias("source_snapshot_ids"))
    return merged.join(refs, "restaurant_id", "left"), extracted.issues, extracted.failures


def collect(uploads: DataFrame, pages: DataFrame, existing_changes: DataFrame, extractor: Extractor, profile_extractor: mapping.Call | None = None) -> Collected:
    """``uploads`` are request bodies (batch_id, body); ``pages`` are captures made
    by a crawler (url, html, fetched_at, and what ``captured_pages`` takes besides).
    ``profile_extractor`` reads description, cuisines and images of the restaurant. A stage that cannot go on for a record
    writes an error row and the record stops there.

    What a stage hands on is fixed in the shared folder, since several later
    stages read it: without that each would run all earlier ones again. Page
    bodies are never part of what is fixed."""
    items, upload_issues = upload_items(uploads)
    queue = fixed(workqueue.enqueue_batch(fixed(items)))
    queued = queue.filter(F.col("status") == "queued").withColumn(
        "restaurant_id", uuid5_url(F.concat(F.lit(SEED_PREFIX), F.col("batch_id").cast("string"), F.lit(":"), batch_name_key(F.col("name"))))
    )
    # An uploaded address is a candidate with full confidence.
    candidates = queued.select(
        "restaurant_id", F.lit(0).alias("pos"), F.col("menu_url").alias("url"),
        F.lit(1.0).alias("provider_confidence"), F.lit("manual").alias("provider_name"),
    )
    resolved = fixed(authority.resolve_sources(queued, candidates))
    verified = fixed(queued.join(resolved.filter(F.col("status") == "verified").select("restaurant_id", "resolved_url"), "restaurant_id"))
    unresolved = resolved.filter(F.col("status") != "verified").select(
        "restaurant_id", F.lit("source_authority").alias("stage"), F.col("reason").alias("error_message")
    )

    stored = captured_pages(pages)
    read = material(verified.select("restaurant_id", "resolved_url", "nutrition_url"), stored)
    links, no_page, captured, documents = read.links, read.no_page, read.captured, read.documents
    snapshots = snap.with_snapshot_id(
        snap.capture(captured, "restaurant_id", "html", F.col("kind"), ["rank", "page_url", "fetched_at"])
    )
    extraction = extract_dishes(documents, extractor)

    profile_issues, failures, profiles = extraction.issues.limit(0), extraction.failures, None
    if profile_extractor is not None:
        profiles, profile_issues, lost = extract_profiles(documents, profile_extractor)
        failures = failures.unionByName(lost)
    # A failed call ends the run of its restaurant, however many calls failed.
    unread = failures.groupBy("restaurant_id").agg(F.min("message").alias("m"), F.count(F.lit(1)).alias("n")).select(
        "restaurant_id", F.lit("multimodal_translation").alias("stage"), F.format_string("%d extraction call(s) failed: %s", "n", "m").alias("error_message"),
    )
    unread = fixed(unread)
    restaurants = fixed(captured.filter("rank = 0").select("restaurant_id").join(unread, "restaurant_id", "left_anti"))
    menus = extraction.dishes.select("restaurant_id", "menu_name").distinct()
    no_locations = restaurants.limit(0)
    outcome = report.run_rules(restaurants, no_locations, menus, extraction.dishes)
    outcome.issues = fixed(outcome.issues)
    outcomes = fixed(report.outcome_per_record(restaurants, outcome.issues, ["restaurant_id"], outcome.log))
    messages = report.first_messages(
        outcome.issues.withColumn("_order", F.coalesce("dish_id", F.lit(""))), ["restaurant_id"], ["_order", "field_path", "code"]
    )
    invalid = outcomes.filter(~F.col("is_valid")).join(messages, "restaurant_id").select(
        "restaurant_id", F.lit("deterministic_validation").alias("stage"),
        F.concat(F.lit("found "), F.col("errors").cast("string"), F.lit(" error(s): "), "first_errors").alias("error_message"),
    )
    valid = outcomes.filter("is_valid").join(verified.select("restaurant_id", "name", "resolved_url", "batch_id", "pos"), "restaurant_id")
    known = valid.withColumn("website_url", F.col("resolved_url")).withColumns(
        {f: F.lit(None).cast(PROFILE_SCHEMA[f].dataType) for f in PROFILE_FIELDS} | {"cuisine_types": F.array().cast("array<string>")}
    )
    if profiles is not None:
        known = mapping.merge_profiles(known, fixed(profiles))
    run_id = uuid5_url(F.concat(F.lit("run:collect:"), "restaurant_id"))
    batch = known.select(
        uuid5_url(F.concat(F.lit("change:"), "restaurant_id")).alias("id"),
        F.lit("restaurant").alias("entity_type"),
        F.col("restaurant_id").alias("entity_id"),
        F.to_json(F.struct("name", "website_url", *PROFILE_FIELDS)).alias("structured_json"),
        F.to_json(F.struct("is_valid", "errors", "warnings")).alias("validation_result"),
        F.lit("pending").alias("status"),
        F.concat(F.lit("collect:"), "restaurant_id").alias("thread_id"),
        run_id.alias("agent_run_id"),
        F.col("pos").cast("long").alias("pos"),
    )
    staged = fixed(review.new_changes(existing_changes, batch).drop("pos"))
    bad_uploads = upload_issues.select(
        F.lit(None).cast("string").alias("restaurant_id"), F.lit("upload").alias("stage"),
        F.concat_ws(" ", F.col("batch_id").cast("string"), F.col("pos").cast("string"), "field_path", "message").alias("error_message"),
    )
    bad_rows = extraction.issues.select("restaurant_id", "field_path", "message").unionByName(profile_issues.select("restaurant_id", "field_path", "message")).select(
        "restaurant_id", F.lit("multimodal_translation").alias("stage"), F.concat_ws(" ", "field_path", "message").alias("error_message")
    )
    too_many = read.lost_links.groupBy("restaurant_id").agg(F.count(F.lit(1)).alias("n")).select(
        "restaurant_id", F.lit("discovery").alias("stage"), F.format_string("%d link(s) beyond the first %d not followed", F.col("n"), F.lit(pg.LINKS_PER_PAGE)).alias("error_message"),
    )
    # One of these ends the run of a restaurant; what goes on waits for its review.
    ended = fixed(unresolved.unionByName(no_page.select("restaurant_id", "stage", "error_message")).unionByName(unread).unionByName(invalid))
    run_rows = queued.select("restaurant_id").join(ended, "restaurant_id", "left").select(
        run_id.alias("id"), F.lit("collector_workflow").alias("workflow_type"), "restaurant_id",
        F.when(F.col("stage").isNotNull(), "failed").otherwise("running").alias("status"), "error_message",
    )
    told = lambda **facts: F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v.cast("string"))]).alias("metadata")
    event = lambda action, kind, entity, metadata: [F.lit(action).alias("action"), F.lit(kind).alias("entity_type"), entity.alias("entity_id"), metadata]
    dish_counts = restaurants.join(outcome.dishes.groupBy("restaurant_id").agg(F.count(F.lit(1)).alias("n")), "restaurant_id", "left")
    events = ended.select(*event("agent_run.trigger", "agent_run", run_id, told(node=F.col("stage"), error=F.col("error_message")))).unionByName(
        outcomes.filter("is_valid AND corrected_fields > 0").select(*event(
            "agent_run.trigger", "agent_run", run_id,
            told(node=F.lit("deterministic_validation"), errors=F.col("errors"), warnings=F.col("warnings"), corrected_fields=F.col("corrected_fields")),
        ))
    ).unionByName(
        dish_counts.select(*event("ai.extraction", "agent_run", run_id, told(node=F.lit("multimodal_translation"), restaurant_id=F.col("restaurant_id"), dishes=F.coalesce("n", F.lit(0)))))
    ).unionByName(
        staged.select(*event("proposed_change.create", "proposed_change", F.col("id"), told(node=F.lit("human_review"), restaurant_id=F.col("entity_id"))))
    )
    errors = bad_uploads
    for e in (too_many, unresolved, no_page.select("restaurant_id", "stage", "error_message"), unread, bad_rows, invalid):
        errors = errors.unionByName(e)
    return Collected(
        queue, resolved, authority.verified_source_rows(resolved, F.current_timestamp()), snapshots, links,
        outcome.dishes, outcome.issues, outcome.log, outcomes, staged, errors,
        read.to_render, run_rows, audit.audit_rows(events),
    )
