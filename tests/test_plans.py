"""Composed jobs end to end on a small fixture."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from menuloom.plans import collect as c, decide
from menuloom.sources import audit, versions
from menuloom.suite.base import Tables
from menuloom.suite.jobs import link_text_extractor, published, profile_sweep, sweep

PAGE = '<html><title>{0}</title><a href="/menu">Menu of {0}</a><a href="/x">Soup</a></html>'


def test_collect(spark):
    items = [
        {"name": "One", "menu_url": "one.example.org/start", "nutrition_url": "https://one.example.org/nutrition"},
        {"name": " one ", "menu_url": "two.example.org", "nutrition_url": "https://two.example.org/n"},
        {"name": "Yelped", "menu_url": "https://www.yelp.com/biz/x", "nutrition_url": "https://x.example.org"},
        {"name": "Uncrawled", "menu_url": "https://nowhere.example.org", "nutrition_url": "https://nowhere.example.org/n"},
        {"name": "Empty", "menu_url": "https://empty.example.org", "nutrition_url": "https://empty.example.org/n"},
        {"name": "", "menu_url": "a", "nutrition_url": "b"},
    ]
    uploads = spark.createDataFrame([("b1", json.dumps(items)), ("b2", "{}")], "batch_id string, body string")
    pages = spark.createDataFrame(
        [("https://one.example.org/start", PAGE.format("One"), 1), ("https://one.example.org/start?utm_source=x", PAGE.format("older"), 0),
         ("https://one.example.org/menu", '<a href="/">Extra dish</a>', 1), ("https://empty.example.org/", "<p>nothing here", 1)],
        "url string, html string, at long",
    ).withColumn("fetched_at", F.timestamp_seconds("at"))
    none = spark.createDataFrame([], "thread_id string")
    out = c.collect(uploads, pages, none, link_text_extractor)
    assert {r.name: r.status for r in out.queue.collect()} == {"One": "queued", " one ": "skipped", "Yelped": "queued", "Uncrawled": "queued", "Empty": "queued"}
    assert sorted(r.page_url for r in out.snapshots.collect()) == ["https://empty.example.org/", "https://one.example.org/menu", "https://one.example.org/start"]
    assert sorted(r.name for r in out.dishes.collect()) == ["Extra dish", "Menu of One", "Soup"]
    staged = out.staged.collect()
    assert [json.loads(r.structured_json)["name"] for r in staged] == ["One"]
    stages = sorted(r.stage for r in out.errors.collect())
    assert stages == ["deterministic_validation", "extraction", "source_authority", "upload", "upload"]
    again = c.collect(uploads, pages, spark.createDataFrame([(staged[0].thread_id,)], "thread_id string"), link_text_extractor)
    assert again.staged.count() == 0


def test_collect_kinds_profiles_and_runs(spark):
    names = c.PROFILE_SCHEMA.names

    def _cuisine_profile(pdf):
        """The first heading is the description; a word in it is the cuisine."""
        rows = []
        for restaurant, content in zip(pdf["restaurant_id"], pdf["content"]):
            title = content.partition("<title>")[2].partition("</title>")[0]
            rows.append({"restaurant_id": restaurant, "pos": 0, "description": title or None, "cuisine_types": ["thai"] if "Thai" in title else [], "logo_url": None,
                         "cover_image_url": "", "confidence": 1.0, "source_snapshot_ids": [content[10:74]]})
        return pd.DataFrame(rows, columns=names)

    hosts = {"Good": "good", "Printed": "pdf", "Guarded": "guard"}
    items = [{"name": n, "menu_url": f"https://{h}.example.org/start", "nutrition_url": f"https://{h}.example.org/n"} for n, h in hosts.items()]
    uploads = spark.createDataFrame([("b", json.dumps(items))], "batch_id string, body string")
    page = '<title>Thai food</title><a href="/menu">The menu</a>'
    pages = spark.createDataFrame(
        [("https://good.example.org/start", bytearray(page.encode()), "text/html", 200, 1), ("https://good.example.org/start", bytearray(b"Just a moment..."), "text/html", 503, 2),
         ("https://good.example.org/menu", bytearray(b"%PDF \xff\xfe"), "application/pdf", 200, 1), ("https://pdf.example.org/start", bytearray(b"%PDF <a href='/x'>No dish</a>"), "application/pdf", 200, 1),
         ("https://guard.example.org/start", bytearray(b"Just a moment..."), "text/html", 403, 1)],
        "url string, html binary, content_type string, http_status int, at long",
    ).withColumn("fetched_at", F.timestamp_seconds("at"))
    out = c.collect(uploads, pages, spark.createDataFrame([], "thread_id string"), link_text_extractor, _cuisine_profile)
    name = {r.restaurant_id: r.name for r in out.queue.select(c.uuid5_url(F.concat(F.lit(c.SEED_PREFIX), "batch_id", F.lit(":"), F.lower("name"))).alias("restaurant_id"), "name").collect()}
    kinds = {(name[r.source_id], r.page_url.rsplit("/", 1)[1]): r.content_type for r in out.snapshots.collect()}
    assert kinds == {("Good", "start"): "html", ("Good", "menu"): "pdf", ("Printed", "start"): "pdf"}
    assert [r.name for r in out.dishes.collect()] == ["The menu"]
    staged = json.loads(out.staged.first().structured_json)
    assert staged == {"name": "Good", "website_url": "https://good.example.org/start", "description": "Thai food", "cuisine_types": ["thai"]}
    assert {(name[r.restaurant_id], r.stage) for r in out.errors.collect()} == {("Guarded", "extraction"), ("Printed", "deterministic_validation")}
    assert "challenge" in out.errors.filter("stage = 'extraction'").first().error_message
    assert {name[r.restaurant_id]: r.status for r in out.runs.collect()} == {"Good": "running", "Guarded": "failed", "Printed": "failed"}
    assert [name[r.restaurant_id] for r in out.to_render.collect()] == ["Good"]
    assert sorted(r.action for r in out.audit.collect()) == ["agent_run.trigger", "agent_run.trigger", "ai.extraction", "ai.extraction", "proposed_change.create"]
    assert audit.unknown_entries(out.audit).count() == 0
    assert out.staged.first().agent_run_id in {r.id for r in out.runs.filter("status = 'running'").collect()}


def test_review_sweep(spark):
    out = sweep(Tables(spark, "/root/testdata/sf0.001"))
    changed = {r.restaurant_id for r in out.gate.filter("changed").collect()}
    assert out.delta.filter("op = 'added' and name_key = 'brand new dish'").select("restaurant_id").distinct().count() > 0
    assert {r.restaurant_id for r in out.delta.select("restaurant_id").distinct().collect()} <= changed
    assert {r.entity_id for r in out.staged.collect()} == changed
    assert all(r.source_snapshot_ids for r in out.delta.filter("op = 'added'").collect())


def test_review_stages_the_profile(spark):
    out = profile_sweep(Tables(spark, "/root/testdata/sf0.001"))
    staged = {r.id: json.loads(r.structured_json) for r in out.staged.collect()}
    lines = out.profile_delta.collect()
    assert lines and {r.change_id for r in lines} <= set(staged) and all(r.source_snapshot_ids for r in lines)
    dishes = {r.restaurant_id: r["count"] for r in out.delta.groupBy("restaurant_id").count().collect()}
    told = {}
    for r in lines:
        told.setdefault((r.change_id, r.restaurant_id), set()).add(r.field)
    for (change, restaurant), fields in told.items():
        assert set(staged[change]) == {"changes", *fields} and staged[change]["description"] == "with news"
        assert staged[change]["changes"] == dishes.get(restaurant, 0) + len(fields)
    assert decide.record_errors(out.staged).count() == 0


def test_publish(spark, tmp_path):
    result = published(Tables(spark, "/root/testdata/sf0.001"))
    version = decide.write(spark, result, str(tmp_path / "catalog"), str(tmp_path / "audit"))
    assert version == 1
    assert versions.read_version(spark, str(tmp_path / "catalog"), "dishes").count() == result.dishes.count()
    log = audit.read_audit(spark, str(tmp_path / "audit"))
    assert log.filter("action = 'proposed_change.publish'").count() == result.published.count()
    statuses = {r.status for r in result.changes.join(result.published.select("id"), "id", "left_semi").select("status").distinct().collect()}
    assert statuses <= {"published"}


@pytest.mark.parametrize("name", ["dishes", "changes", "approvals", "refused_decisions", "refused_changes"])
def test_outputs_are_tables(spark, name):
    assert getattr(published(Tables(spark, "/root/testdata/sf0.001")), name).columns
