import hashlib
import random
import json

import pytest
from pyspark.sql import functions as F

from menuloom.operators import pages as pg
from menuloom.sources import audit, snapshots, upload, versions

HTML = """<html><head><title> The Diner &amp; Co </title><meta name="description" content=" Good food ">
<link rel="alternate canonical" href=" https://d.example/ "><meta property="og:title" content="OG"><meta property="og:image"></head><body>
<a href="/menu">Food <b>list</b></a><a href="/p/1">Our Menu</a><a href="nutrition-facts.pdf">PDF</a><a href="/about">About</a>
<a href="https://other.example/menu">Else</a><a href="/menu">Again</a><a>no href, menu</a><a href="  ">menu</a><A HREF="/ORDER">x<script>var menu</script></A>
</body></html>"""


def parsed(spark, html=HTML, url="https://www.d.example/home/", domain="d.example"):
    rows = spark.createDataFrame([(1, url, html, domain)], "page_id long, url string, html string, domain string")
    return pg.parse_pages(rows, ["page_id", "domain"])


def test_page_metadata(spark):
    row = pg.page_metadata(parsed(spark)).first()
    assert (row.title, row.description, row.canonical_url, row.og_title, row.og_description, row.og_image) == (
        "The Diner & Co", "Good food", "https://d.example/", "OG", None, None)
    empty = pg.page_metadata(parsed(spark, html="<p>nothing")).first()
    assert set(empty[2:]) == {None}


def test_link_discovery(spark):
    links = pg.discover_links(parsed(spark), ["page_id"], "domain").orderBy("rank").collect()
    assert [r.absolute_url for r in links] == [
        "https://www.d.example/menu", "https://www.d.example/p/1", "https://www.d.example/home/nutrition-facts.pdf", "https://www.d.example/ORDER"]
    assert pg.discover_links(parsed(spark), ["page_id"], "domain", limit=2).count() == 2
    assert pg.discover_links(parsed(spark, domain="www.d.example"), ["page_id"], "domain").count() == 4
    assert pg.discover_links(parsed(spark, domain="example"), ["page_id"], "domain").count() == 0
    many = "".join(f'<a href="/menu/{i}">m</a>' for i in range(30))
    assert pg.discover_links(parsed(spark, html=many), ["page_id"], "domain").count() == 10


def test_access_rules(spark):
    rules = spark.createDataFrame(
        [("a.com", 0, True, "/menu/open"), ("a.com", 1, False, "/menu"), ("b.com", 0, False, "")], "domain string, seq int, allow boolean, path string"
    )
    pages = spark.createDataFrame([("a.com", "/menu/open/1"), ("a.com", "/menu/x"), ("a.com", "/"), ("b.com", "/z"), ("c.com", "/z")], "d string, p string")
    got = {(r.d, r.p): r.allowed for r in pg.allowed_by_rules(pages, rules, "d", "p").collect()}
    assert got == {("a.com", "/menu/open/1"): True, ("a.com", "/menu/x"): False, ("a.com", "/"): True, ("b.com", "/z"): True, ("c.com", "/z"): True}


def _first_rule(rules, host, path):
    """The rule file read one line at a time."""
    for domain, seq, allow, prefix in sorted(rules, key=lambda r: (r[1], r[2], r[3] or "")):
        if domain == host and host is not None and prefix is not None:
            if prefix in ("", "*") or (path is not None and path.startswith(prefix)):
                return True if prefix == "" else allow
    return True


def test_access_rules_in_many_chunks(spark):
    """Deep nesting, one hot domain, equal paths, stars, nulls and texts beyond ASCII, in chunks so
    small that most begin inside open ranges."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ab/é\U0001F35C") for _ in range(rng.randint(0, n)))
    rules = [("hot" if rng.random() < 0.8 else rng.choice(["b", None]), rng.randint(5, 60), rng.random() < 0.5, rng.choice([None, "*", ""]) if rng.random() < 0.01 else "/" + word(7)) for _ in range(400)]
    rules += [("deep", 100 - n, n % 2 == 0, "/" + "x" * n) for n in range(60)]
    pages = [(i, "hot" if rng.random() < 0.7 else rng.choice(["b", "c", None]), rng.choice([None, "", "/" + word(9)])) for i in range(1500)]
    pages += [(2000 + i, "hot", "/ab") for i in range(300)] + [(3000 + n, "deep", "/" + "x" * n + "y") for n in range(70)]
    r = spark.createDataFrame(rules, "domain string, seq int, allow boolean, path string")
    p = spark.createDataFrame(pages, "id int, host string, path string")
    want = {i: _first_rule(rules, host, path) for i, host, path in pages}
    for parts in (1, 40):
        got = [(x.id, x.allowed) for x in pg.allowed_by_rules(p, r, "host", "path", parts=parts).collect()]
        assert len(got) == len(pages) and dict(got) == want
    assert set(want.values()) == {True, False}
    empty = pg.allowed_by_rules(p, r.limit(0), "host", "path")
    assert empty.filter("allowed").count() == len(pages) and empty.columns == ["id", "host", "path", "allowed"]
    assert pg.allowed_by_rules(p.limit(0), r, "host", "path").count() == 0
    assert "collect_list" not in pg.allowed_by_rules(p, r, "host", "path")._jdf.queryExecution().toString()


def test_capture_and_read_back(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"caf\xc3\xa9 \xff")
    files = snapshots.read_captures(spark, str(tmp_path)).withColumn("source", F.regexp_extract("path", r"([a-z]+)\.html$", 1))
    got = {r.source_id: r for r in snapshots.capture(files, "source", "content", F.lit("html")).collect()}
    blank = spark.createDataFrame([("empty", bytearray())], "source string, content binary")
    empty = snapshots.capture(blank, "source", "content", F.lit("pdf")).first()
    assert (empty.content_hash, empty.content_length_bytes) == (hashlib.sha256(b"").hexdigest(), 0)
    assert empty.storage_path.endswith(".pdf")
    assert got["a"].storage_path == f"a/{hashlib.sha256(b'caf' + bytes([0xc3, 0xa9]) + b' ' + bytes([0xff])).hexdigest()}.html"
    text = snapshots.as_text(files.withColumn("content_type", F.lit("html")), "content")
    assert {r.source: r.text for r in text.collect()} == {"a": "café �"}


def test_upload_files(spark, tmp_path):
    good = [{"name": "A", "menu_url": "a.com", "nutrition_url": "b.com"}, {"name": "B", "menu_url": "a.com", "nutrition_url": "b.com", "x": 1}]
    for name, body in (("good", json.dumps(good, indent=1)), ("empty", "[]"), ("object", "{}"), ("broken", "[")):
        (tmp_path / f"{name}.json").write_text(body)
    uploads = upload.read_uploads(spark, str(tmp_path)).withColumn("batch_id", F.regexp_extract("batch_id", r"([a-z]+)\.json", 1))
    items, errors = upload.upload_items(uploads)
    assert [(r.batch_id, r.pos, r.name) for r in items.collect()] == [("good", 0, "A")]
    assert sorted((r.batch_id, r.field_path) for r in errors.collect()) == [("broken", "items"), ("empty", "items"), ("good", "x"), ("object", "items")]


def test_audit_log_is_append_only(spark, tmp_path):
    events = spark.createDataFrame([("restaurant.edit", "restaurant", "r1", "u1", {"name": "a"}), ("odd", "restaurant", None, None, None)],
                                   "action string, entity_type string, entity_id string, actor_id string, old_values map<string,string>")
    actors = spark.createDataFrame([("u1", "u1@example.com")], "actor_id string, actor_email string")
    rows = audit.audit_rows(events.withColumn("created_at", F.lit("2026-01-02 03:04:05").cast("timestamp")), actors)
    for _ in range(2):
        audit.append_audit(rows, str(tmp_path / "log"))
    stored = audit.read_audit(spark, str(tmp_path / "log"))
    assert stored.count() == 4 and stored.select("id").distinct().count() == 2
    assert stored.filter("actor_email = 'u1@example.com'").first().old_values == '{"name":"a"}'
    assert [r.action for r in audit.unknown_entries(rows).collect()] == ["odd"]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "catalog")
    assert versions.current_version(spark, root) is None
    with pytest.raises(ValueError):
        versions.read_version(spark, root, "dishes")
    assert versions.publish(spark, root, {"dishes": spark.range(3)}) == 1
    patched = versions.read_version(spark, root, "dishes").filter("id > 0")
    assert versions.publish(spark, root, {"dishes": patched}) == 2
    assert versions.read_version(spark, root, "dishes").count() == 2 and versions.read_version(spark, root, "dishes", 1).count() == 3
