"""Queries for the composed jobs."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.urls import canonical_url
from ..operators import catalog, delta as deltas
from ..plans import collect as c, decide, operations, review_sweep
from ..schema import MACROS, MICRONUTRIENTS
from .base import SQL, Tables, query
from .catalog import _restaurants
from .work import _CHANGES, _DECIDED, _ERRORS, _changes, _decisions, _jobs, _outcomes, run_events

_TEXT = re.compile(r'<a href="[^"]*">([^<]+)</a>')
_EMPTY = {"serving_size": None, "macros": dict.fromkeys(MACROS), "micronutrients": dict.fromkeys(MICRONUTRIENTS)}


def link_text_extractor(pdf: pd.DataFrame) -> pd.DataFrame:
    """A deterministic extractor: every link text of the material is a dish, its
    length the price; odd and even lengths are two categories."""
    rows = []
    for restaurant, content in zip(pdf["restaurant_id"], pdf["content"]):
        for i, name in enumerate(_TEXT.findall(content)):
            rows.append({
                "restaurant_id": restaurant, "stub_pos": len(name) % 2, "pos": i, "menu_name": "Menu", "category_name": f"Part {len(name) % 2}",
                "name": name, "description": None, "image_url": None, "nutrition": _EMPTY, "allergens": [], "ingredient_names": [name, " "],
                "quantity": None, "price": float(len(name)), "currency": None, "confidence": 0.5,
                "source_snapshot_ids": [content[10:74]],
            })
    return pd.DataFrame(rows, columns=c.EXTRACTION_SCHEMA.names)


def _sites(t: Tables):
    """Each page under an address of its own."""
    k = F.col("page_id")
    address = F.concat(F.regexp_replace("url", "/*([?#].*)?$", ""), F.lit("/p"), k.cast("string"))
    return t.pages.select(k, address.alias("url"), "html")


def _uploads(t: Tables):
    """Ten pages in a row are one upload, each page one restaurant."""
    k = F.col("page_id")
    item = F.struct(F.concat(F.lit("Site "), (k - k % 11 % 2).cast("string")).alias("name"), F.col("url").alias("menu_url"), F.col("url").alias("nutrition_url"))
    return _sites(t).groupBy(F.floor(k / 10).cast("long").alias("batch_id")).agg(
        F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(k, item.alias("i")))), lambda s: s["i"])).alias("body")
    )


def _captures(t: Tables):
    return _sites(t).select("url", "html", F.timestamp_seconds(F.col("page_id") + 1_700_000_000).alias("fetched_at"))


def _no_changes(t: Tables):
    return t.spark.createDataFrame([], "id string, thread_id string")


@query("b01_collect_staged", """
WITH p AS (SELECT page_id, page_id // 10 AS b, 'Site ' || (page_id - page_id % 11 % 2) AS name, url FROM pages),
q AS (SELECT *, row_number() OVER (PARTITION BY b, name ORDER BY page_id) AS rn FROM p)
SELECT name, 'pending' AS status FROM q WHERE rn = 1""")
def collect_staged(t: Tables):
    """Every page of the shared table is a valid site, so each first name is staged."""
    staged = c.collect(_uploads(t), _captures(t), _no_changes(t), link_text_extractor).staged
    return staged.select(F.get_json_object("structured_json", "$.name").alias("name"), "status")


@query("b01_run_states", """
WITH p AS (SELECT page_id, page_id // 10 AS b, 'Site ' || (page_id - page_id % 11 % 2) AS name FROM pages),
q AS (SELECT *, row_number() OVER (PARTITION BY b, name ORDER BY page_id) AS rn FROM p)
SELECT page_id, CASE WHEN page_id % 7 = 3 OR page_id % 5 = 1 THEN 'failed' ELSE 'running' END AS status,
  CASE WHEN page_id % 7 = 3 THEN 'extraction' WHEN page_id % 5 = 1 THEN 'deterministic_validation' ELSE '' END AS stage FROM q WHERE rn = 1""")
def collect_run_states(t: Tables):
    """Some sites answer with a challenge page and some with a printed menu; neither gives
    a dish, so their runs fail, each at its own stage."""
    n = F.regexp_extract("url", r"/p(\d+)$", 1).cast("long")
    captures = _captures(t).withColumns({
        "content_type": F.when(n % 5 == 1, "application/pdf").otherwise("text/html; charset=utf-8"),
        "http_status": F.when(n % 7 == 3, 403).otherwise(200), "mitigated": F.when(n % 7 == 3, "challenge"),
    })
    out = c.collect(_uploads(t), captures, _no_changes(t), link_text_extractor)
    page = out.resolved.select("restaurant_id", F.regexp_extract("resolved_url", r"/p(\d+)$", 1).cast("long").alias("page_id"))
    ended = out.errors.filter(F.col("restaurant_id").isNotNull() & F.col("stage").isin("extraction", "deterministic_validation")).select("restaurant_id", "stage")
    rows = out.runs.join(page, "restaurant_id").join(ended, "restaurant_id", "left")
    return rows.select("page_id", "status", F.coalesce("stage", F.lit("")).alias("stage"))


def news_profile(pdf: pd.DataFrame) -> pd.DataFrame:
    """The profile of a page: whether it tells of a new dish, and a kitchen."""
    told = ["with news" if "Brand new dish" in content else "" for content in pdf["content"]]
    return pd.DataFrame({
        "restaurant_id": pdf["restaurant_id"], "pos": 0, "description": told, "cuisine_types": [["new"]] * len(pdf),
        "logo_url": None, "cover_image_url": None, "confidence": 1.0,
        # A text begins with the name of its snapshot.
        "source_snapshot_ids": [[content[10:74]] for content in pdf["content"]],
    })


def _sweep(t: Tables, pages, linked, profile_extractor=None):
    """Live: what an earlier capture of each site gave; fresh: the same pages, of which the
    root of every third site gained a link. ``pages`` are roots (page_id, url, html), ``linked``
    pages below them (url, html)."""
    k = F.col("page_id")
    page = pages.select(k, k.cast("string").alias("restaurant_id"), canonical_url(F.col("url"))["url"].alias("url"), "html")
    before = page.select("url", "html").unionByName(linked).withColumn("fetched_at", F.timestamp_seconds(F.lit(0)))
    sites = page.select("restaurant_id", F.col("url").alias("resolved_url"), F.lit(None).cast("string").alias("nutrition_url"))
    read = c.material(sites, c.captured_pages(before))
    live_dishes = c.extract_dishes(read.documents, link_text_extractor).dishes
    sources = page.select(
        F.col("restaurant_id").alias("id"), "restaurant_id", F.lit("restaurant_website").alias("source_type"), "url", F.lit(True).alias("is_verified_domain"), k.alias("created_at"),
    )
    snapshots = read.captured.select(
        F.col("restaurant_id").alias("source_id"), F.col("rank").cast("long").alias("id"), F.lit(0).cast("long").alias("fetched_at"), F.lit("html").alias("content_type"),
        F.sha2("html", 256).alias("content_hash"), "page_url",
    )
    fresh = page.select(
        "url", F.when(k % 3 == 0, F.concat("html", F.lit('<a href="/new">Brand new dish</a>'))).otherwise(F.col("html")).alias("html"),
    ).unionByName(linked).withColumn("fetched_at", F.timestamp_seconds(F.lit(1)))
    running = page.filter(k % 10 == 9).select("restaurant_id")
    hints = page.limit(0).select("restaurant_id", "url", F.lit(True).alias("is_verified_domain"))
    profile = [F.concat(F.lit("old "), "restaurant_id").alias("description"), F.lit(None).cast("string").alias("logo_url"), F.lit(None).cast("string").alias("cover_image_url"),
               F.when(k % 2 == 0, F.array(F.lit("new"))).otherwise(F.array().cast("array<string>")).alias("cuisine_types")]
    return review_sweep.review_sweep(
        page.select("restaurant_id", *profile), live_dishes, sources, hints, snapshots, running, fresh, _no_changes(t), link_text_extractor, profile_extractor,
    )


def sweep(t: Tables):
    return _sweep(t, _sites(t), t.pages.limit(0).select("url", "html"))


_NEW_DISH = "SELECT page_id::VARCHAR AS restaurant_id, 'brand new dish' AS name_key, 'added' AS op FROM pages WHERE page_id % 3 = 0 AND page_id % 10 <> 9"


@query("b02_review_delta", _NEW_DISH)
def review_delta(t: Tables):
    return sweep(t).delta.select("restaurant_id", "name_key", "op")


@query("b02_review_gate", """
SELECT page_id::VARCHAR AS restaurant_id, sha256(html) AS previous_hash,
  sha256(html || CASE WHEN page_id % 3 = 0 THEN '<a href="/new">Brand new dish</a>' ELSE '' END) AS content_hash, page_id % 3 = 0 AS changed
FROM pages WHERE page_id % 10 <> 9""")
def review_gate(t: Tables):
    return sweep(t).gate.select("restaurant_id", "previous_hash", "content_hash", "changed")


def profile_sweep(t: Tables):
    return _sweep(t, _sites(t), t.pages.limit(0).select("url", "html"), news_profile)


@query("b02_review_profile", """
WITH p AS (SELECT page_id::VARCHAR AS restaurant_id, page_id FROM pages WHERE page_id % 3 = 0 AND page_id % 10 <> 9)
SELECT restaurant_id, 'description' AS field, 'old ' || page_id AS old_value, 'with news' AS new_value FROM p
UNION ALL SELECT restaurant_id, 'cuisine_types', '[]', '["new"]' FROM p WHERE page_id % 2 = 1""")
def review_profile(t: Tables):
    return profile_sweep(t).profile_delta.select("restaurant_id", "field", "old_value", "new_value")


@query("b02_review_linked_pages", _NEW_DISH + " AND page_id % 2 = 0")
def review_linked_pages(t: Tables):
    """Even pages are roots that link to the page after them: no dish of a linked page is
    taken for removed when only the root changed."""
    k = F.col("page_id")
    site = lambda n: F.concat(F.lit("https://site"), n.cast("string"), F.lit(".example.org/"))
    roots = t.pages.filter(k % 2 == 0).select(k, site(k).alias("url"), F.concat("html", F.lit('<a href="/menu">Whole menu</a>')).alias("html"))
    linked = t.pages.filter(k % 2 == 1).select(F.concat(site(k - 1), F.lit("menu")).alias("url"), "html")
    return _sweep(t, roots, linked).delta.select("restaurant_id", "name_key", "op")


def published(t: Tables):
    """Orders are changes of customers; what a reviewer edits is the name, and an empty
    one must be refused. Customers with an even key are live."""
    k = F.col("c_custkey")
    lines = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey", F.col("l_quantity").alias("qty"))
    rows = lines.join(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity_id")), "id")
    target = rows.groupBy("entity_id", "id", "line", "l_partkey", "l_suppkey").agg(F.min("qty").alias("qty"))
    live = target.filter(F.col("entity_id") % 2 == 0).withColumn("qty", F.when(F.col("l_partkey") % 4 == 0, F.col("qty") + 1).otherwise(F.col("qty")))
    keys = ["id", "line", "l_partkey", "l_suppkey"]
    # What differs in the lines of an order is the delta of that order's change.
    changed = deltas.table_diff(live, target.filter(F.col("entity_id") % 2 == 0), ["entity_id", *keys], ["qty"]).withColumn("change_id", F.col("id"))
    profile = t.customer.select(k.alias("entity_id"), F.col("c_name").alias("name"), F.when(k % 3 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("description"), F.concat(F.lit("https://c.example/"), k).alias("website_url"))
    shown = profile.filter("entity_id % 2 = 0").withColumn("description", F.lower("description"))
    # The changed description belongs to every fourth order of a customer.
    orders = t.orders.filter(F.col("o_orderkey") % 4 == 1).select(F.col("o_orderkey").alias("change_id"), F.col("o_custkey").alias("entity_id"))
    profile_delta = deltas.table_diff(shown, profile.filter("entity_id % 2 = 0"), ["entity_id"], ["description"]).select("entity_id", "field").join(orders, "entity_id")
    menus = t.orders.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("menu_id"), F.col("o_orderpriority").alias("name"))
    runs = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") % 2 == 1, "reviewer_workflow").otherwise("collector_workflow").alias("workflow_type"))
    as_json = lambda **fields: F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))
    changes = _changes(t).withColumn("structured_json", as_json(name=F.concat(F.lit("n"), "id")))
    name = F.when(F.col("seq") % 5 == 0, " ").otherwise(F.concat(F.lit("e"), "seq"))
    decisions = _decisions(t).withColumn("edited_structured_json", as_json(name=name, website_url=F.concat(F.lit("https://e.example/"), "seq")))
    outcomes = _outcomes(t)

    def check(approved):
        found = outcomes.unionByName(decide.record_errors(approved))
        return found.groupBy("id").agg(F.sum("errors").alias("errors"))

    return decide.decide_and_publish(
        changes, decisions, runs, check, {"restaurants": shown, "menus": menus.filter("entity_id % 2 = 0 AND menu_id % 2 = 0"), "dishes": live},
        {"restaurants": profile, "menus": menus, "dishes": target}, changed, keys, profile_delta,
    )


_PUBLISHED = f"""{_DECIDED}, {_ERRORS},
tg AS (SELECT o_custkey AS entity_id, l_orderkey AS id, l_linenumber AS line, l_partkey, l_suppkey, min(l_quantity) AS qty FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
app AS (SELECT ch.id, ch.entity_id, agent_run_id < 25 AND agent_run_id % 2 = 1 AS reviewer, action = 'edit_then_approve' AS edited, seq,
    coalesce(errors, 0) + (action = 'edit_then_approve' AND seq % 5 = 0)::INT AS errors
  FROM ch JOIN a ON a.proposed_change_id = ch.id LEFT JOIN e ON e.id = ch.id WHERE decision = 'approved'),
ok AS (SELECT * FROM app WHERE errors = 0),
firsts AS (SELECT min(id) AS id, entity_id FROM ok WHERE NOT reviewer
  AND NOT EXISTS (SELECT 1 FROM ch p WHERE p.status = 'published' AND p.entity_id = ok.entity_id AND p.id <> ok.id) GROUP BY entity_id),
patches AS (SELECT id, entity_id FROM ok WHERE reviewer AND entity_id % 2 = 0
  AND (id IN (SELECT id FROM tg WHERE l_partkey % 4 = 0) OR id % 4 = 1 AND entity_id % 3 = 0)),
pub AS (SELECT id FROM firsts UNION ALL SELECT id FROM patches)"""


@query("b03_decided_changes", f"""WITH {_PUBLISHED}
SELECT ch.id, CASE WHEN decision IS NULL THEN status WHEN ch.id IN (SELECT id FROM pub) THEN 'published' ELSE decision END AS status
FROM ch LEFT JOIN a ON a.proposed_change_id = ch.id""")
def decided(t: Tables):
    return published(t).changes.select("id", "status")


@query("b03_published_dishes", f"""WITH {_PUBLISHED}
SELECT entity_id, id, line, l_partkey, l_suppkey, CASE WHEN entity_id IN (SELECT entity_id FROM firsts) OR id IN (SELECT id FROM patches) OR l_partkey % 4 <> 0
  THEN qty ELSE qty + 1 END AS qty FROM tg WHERE entity_id % 2 = 0 OR entity_id IN (SELECT entity_id FROM firsts)""")
def published_dishes(t: Tables):
    return published(t).dishes.select("entity_id", "id", "line", "l_partkey", "l_suppkey", "qty")


@query("b03_published_profiles", f"""WITH {_PUBLISHED},
f AS (SELECT entity_id, CASE WHEN edited THEN 'e' || seq ELSE 'n' || id END AS name, CASE WHEN edited THEN 'https://e.example/' || seq END AS site FROM firsts JOIN ok USING (id, entity_id)),
rev AS (SELECT entity_id, arg_max(CASE WHEN edited THEN 'https://e.example/' || seq ELSE '' END, id) AS site, bool_or(id % 4 = 1) AS told FROM patches JOIN ok USING (id, entity_id) GROUP BY 1)
SELECT c_custkey AS entity_id, coalesce(f.name, c_name) AS name, coalesce(f.site, nullif(rev.site, ''), 'https://c.example/' || c_custkey) AS website_url,
  CASE WHEN c_custkey % 3 = 0 AND (f.entity_id IS NOT NULL OR told) THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS description
FROM customer LEFT JOIN f ON f.entity_id = c_custkey LEFT JOIN rev ON rev.entity_id = c_custkey AND f.entity_id IS NULL WHERE c_custkey % 2 = 0 OR f.entity_id IS NOT NULL""")
def published_profiles(t: Tables):
    return published(t).tables["restaurants"].select("entity_id", "name", "website_url", "description")


@query("b03_published_menus", f"""WITH {_PUBLISHED}
SELECT o_custkey AS entity_id, o_orderkey AS menu_id FROM orders WHERE o_custkey IN (SELECT entity_id FROM firsts) OR o_custkey % 2 = 0 AND o_orderkey % 2 = 0""")
def published_menus(t: Tables):
    return published(t).tables["menus"].select("entity_id", "menu_id")


@query("b03_run_results", f"""WITH {_PUBLISHED}
SELECT id, id % 50 AS agent_run_id, CASE WHEN id IN (SELECT id FROM pub) THEN 'succeeded' ELSE 'failed' END AS status,
  CASE WHEN id IN (SELECT id FROM pub) THEN '' WHEN reviewer AND id NOT IN (SELECT id FROM tg WHERE entity_id % 2 = 0 AND l_partkey % 4 = 0)
      AND NOT (id % 4 = 1 AND entity_id % 3 = 0 AND entity_id % 2 = 0) THEN 'missing_input'
    WHEN errors > 0 THEN 'revalidation_failed' WHEN reviewer THEN 'not_in_production' ELSE 'already_published' END AS error FROM app""")
def run_results(t: Tables):
    return published(t).runs.select("id", "agent_run_id", "status", F.coalesce("error_message", F.lit("")).alias("error"))


# A catalog of ten entities: categories are customers, in half of them a chain and else a binary
# tree, three roots and their menus each; dishes are orders, locations suppliers. In the new
# version menus and categories go, categories move under another root, cities and prices change.
_TREE = """
c0 AS (SELECT c_custkey AS id, c_custkey % 10 AS e, c_custkey // 10 AS i, c_mktsegment AS name FROM customer),
c1 AS (SELECT id, e, i, name, CASE WHEN i < 3 THEN NULL WHEN e % 2 = 0 THEN (i - 3) * 10 + e ELSE (i // 2) * 10 + e END AS parent, CASE WHEN i < 3 THEN e * 10 + i END AS menu FROM c0),
m1 AS (SELECT e * 10 + j AS id, e, 'menu ' || j AS name FROM range(10) AS a(e), range(3) AS b(j)),
c2 AS (SELECT id, e, i, CASE WHEN id % 13 = 1 THEN lower(name) ELSE name END AS name, CASE WHEN i > 3 AND id % 11 = 5 THEN 20 + e ELSE parent END AS parent, menu FROM c1 WHERE id % 17 <> 3),
lost AS (SELECT id FROM c1 WHERE id % 17 = 3),
dead AS (SELECT id, e FROM c2 WHERE (e % 4 <> 0 AND menu % 10 = 1) OR parent IN (FROM lost) UNION SELECT c2.id, c2.e FROM c2 JOIN dead ON c2.parent = dead.id),
d1 AS (SELECT o_orderkey AS id, o_custkey % 10 AS e, o_custkey AS cat, o_totalprice AS price FROM orders),
d2 AS (SELECT id, e, cat, CASE WHEN id % 13 = 0 THEN price + 1 ELSE price END AS price FROM d1 WHERE id % 31 <> 0)"""


def _catalog(t: Tables, new: bool) -> dict:
    key = F.col("c_custkey")
    e, i = key % 10, F.floor(key / 10).cast("long")
    parent = F.when(i >= 3, F.when(e % 2 == 0, (i - 3) * 10 + e).otherwise(F.floor(i / 2).cast("long") * 10 + e))
    moved = (i > 3) & (key % 11 == 5)
    was = lambda old, when, value: F.when(when, value).otherwise(old) if new else old
    menus = t.spark.range(30).select((F.col("id") / 3).cast("long").alias("entity_id"), (F.col("id") % 3).alias("j"))
    tables = {
        "locations": t.supplier.select(
            (F.col("s_suppkey") % 10).alias("entity_id"), F.col("s_suppkey").alias("location_id"),
            was(F.col("s_name"), F.col("s_suppkey") % 5 == 2, F.upper("s_name")).alias("city")),
        "menus": menus.select("entity_id", (F.col("entity_id") * 10 + F.col("j")).alias("menu_id"), F.concat(F.lit("menu "), "j").alias("name")),
        "categories": t.customer.select(
            e.alias("entity_id"), key.alias("category_id"),
            was(F.col("c_mktsegment"), key % 13 == 1, F.lower("c_mktsegment")).alias("name"), was(parent, moved, 20 + e).alias("parent_id"),
            F.when(i < 3, e * 10 + i).alias("menu_id")),
        "dishes": t.orders.select(
            (F.col("o_custkey") % 10).alias("entity_id"), F.col("o_orderkey").alias("dish_id"), F.col("o_custkey").alias("category_id"),
            was(F.col("o_totalprice"), F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).alias("price")),
    }
    if new:
        tables["locations"] = tables["locations"].filter("location_id % 7 <> 3")
        tables["menus"] = tables["menus"].filter("entity_id % 4 = 0 OR menu_id % 10 <> 1")
        tables["categories"] = tables["categories"].filter("category_id % 17 <> 3")
        tables["dishes"] = tables["dishes"].filter("dish_id % 31 <> 0")
    return tables


def patched_catalog(t: Tables) -> catalog.Patched:
    live, target = _catalog(t, False), _catalog(t, True)
    return catalog.apply_catalog_delta(live, target, catalog.catalog_diff(live, target))


@query("b02_catalog_delta", f"""WITH {_TREE}
SELECT 'locations' AS "table", s_suppkey % 10 AS entity_id, s_suppkey AS id, CASE WHEN s_suppkey % 7 = 3 THEN '' ELSE 'city' END AS field, CASE WHEN s_suppkey % 7 = 3 THEN 'removed' ELSE 'changed' END AS op
  FROM supplier WHERE s_suppkey % 7 = 3 OR (s_suppkey % 5 = 2 AND upper(s_name) <> s_name)
UNION ALL SELECT 'menus', e, id, '', 'removed' FROM m1 WHERE e % 4 <> 0 AND id % 10 = 1
UNION ALL SELECT 'categories', e, id, '', 'removed' FROM c1 WHERE id IN (FROM lost)
UNION ALL SELECT 'categories', c1.e, c1.id, 'name', 'changed' FROM c1 JOIN c2 USING (id) WHERE c1.name <> c2.name
UNION ALL SELECT 'categories', c1.e, c1.id, 'parent_id', 'changed' FROM c1 JOIN c2 USING (id) WHERE c1.parent IS DISTINCT FROM c2.parent
UNION ALL SELECT 'dishes', d1.e, d1.id, CASE WHEN d2.id IS NULL THEN '' ELSE 'price' END, CASE WHEN d2.id IS NULL THEN 'removed' ELSE 'changed' END FROM d1 LEFT JOIN d2 USING (id) WHERE d2.id IS NULL OR d1.price <> d2.price""".replace("WITH", "WITH RECURSIVE", 1))
def catalog_delta(t: Tables):
    changes = catalog.catalog_diff(_catalog(t, False), _catalog(t, True))
    lines = [d.select(F.lit(x.table).alias("table"), "entity_id", F.col(x.id).alias("id"), F.coalesce("field", F.lit("")).alias("field"), "op") for x in catalog.LEVELS for d in [changes[x.table]]]
    return reduce(DataFrame.unionAll, lines)


@query("b03_catalog_patch", f"""WITH {_TREE}
SELECT 'locations' AS "table", s_suppkey % 10 AS entity_id, s_suppkey AS id, -1 AS ref, CASE WHEN s_suppkey % 5 = 2 THEN upper(s_name) ELSE s_name END AS value FROM supplier WHERE s_suppkey % 7 <> 3
UNION ALL SELECT 'menus', e, id, -1, name FROM m1 WHERE e % 4 = 0 OR id % 10 <> 1
UNION ALL SELECT 'categories', e, id, coalesce(parent, menu), name FROM c2 WHERE id NOT IN (SELECT id FROM dead)
UNION ALL SELECT 'dishes', e, id, cat, CAST(CAST(round(price * 100) AS BIGINT) AS VARCHAR) FROM d2 WHERE cat NOT IN (FROM lost) AND cat NOT IN (SELECT id FROM dead)""".replace("WITH", "WITH RECURSIVE", 1))
def catalog_patch(t: Tables):
    tables = patched_catalog(t).tables
    shown = {
        "locations": ("location_id", F.lit(-1), F.col("city")), "menus": ("menu_id", F.lit(-1), F.col("name")),
        "categories": ("category_id", F.coalesce("parent_id", "menu_id"), F.col("name")),
        "dishes": ("dish_id", F.col("category_id"), F.round(F.col("price") * 100).cast("long").cast("string")),
    }
    rows = [tables[name].select(F.lit(name).alias("table"), "entity_id", F.col(id).alias("id"), ref.cast("long").alias("ref"), value.alias("value")) for name, (id, ref, value) in shown.items()]
    return reduce(DataFrame.unionAll, rows)


@query("b03_catalog_cascade", f"""WITH {_TREE}
SELECT 'categories' AS "table", e AS entity_id, CAST(id AS VARCHAR) AS id FROM dead
UNION ALL SELECT 'dishes', e, CAST(id AS VARCHAR) FROM d2 WHERE cat IN (FROM lost) OR cat IN (SELECT id FROM dead)""".replace("WITH", "WITH RECURSIVE", 1))
def catalog_cascade(t: Tables):
    return patched_catalog(t).cascaded


_RULE_ERRORS = SQL["p11_issue_split"]


@query("b03_revalidation", f"""WITH i AS ({_RULE_ERRORS}), n AS (SELECT restaurant_id, count(*) AS errors FROM i GROUP BY 1),
r AS (SELECT DISTINCT p_partkey // 20 AS restaurant_id FROM part)
SELECT restaurant_id AS id, coalesce(errors, 0) + CASE restaurant_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS errors FROM r LEFT JOIN n USING (restaurant_id)""")
def revalidation(t: Tables):
    """Each restaurant's change is checked again: every rule on its rows, and its edited JSON,
    of which some have a blank name or two wrong fields."""
    r = F.col("restaurant_id")
    restaurants = t.dishes.select(r.alias("entity_id")).distinct()
    edited = F.when(F.col("entity_id") % 5 == 0, F.lit('{"name":" "}')).when(F.col("entity_id") % 5 == 1, F.lit('{"name":"x","cuisine_types":5,"color":"red"}')).otherwise(F.lit('{"name":"x"}'))
    changes = restaurants.select(F.col("entity_id").alias("id"), "entity_id", edited.alias("structured_json"))
    return decide.revalidation({"restaurants": restaurants, "dishes": t.dishes.withColumnRenamed("restaurant_id", "entity_id")})(changes)


_RUN_STATES = """WITH e AS (SELECT event_id // 5 AS run_id, event_id, ts, CASE WHEN event_id % 5 = 0 THEN 'start' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'succeeded' ELSE 'note' END AS kind FROM events),
x AS (SELECT run_id, coalesce(arg_max(kind, (ts, event_id)) FILTER (kind IN ('failed', 'succeeded')), 'running') AS status FROM e GROUP BY 1)"""


def _report(t: Tables):
    restaurants = _restaurants(t)
    lines = t.lineitem.select(F.col("l_orderkey").alias("restaurant_id"), F.col("l_returnflag").alias("city"), F.struct("l_linenumber", "l_partkey").alias("location_id"))
    updates = t.events.select(F.floor(F.col("event_id") / 5).cast("long").alias("run_id"), F.col("event_id").alias("seq"), F.create_map(F.lit("node"), F.col("event_type")).alias("metrics"))
    return operations.operations_report(restaurants, lines, lines, _changes(t), run_events(t), updates, _jobs(t))


@query("b04_operations_report", f"""{_RUN_STATES}
SELECT status, count(*) AS runs FROM x GROUP BY 1""")
def run_outcomes(t: Tables):
    return _report(t).run_outcomes.select("status", "runs")


@query("b04_dead_letters", SQL["a08_dead_letter_sweep"])
def dead_letters(t: Tables):
    return _report(t).dead_letters


@query("b04_counters", f"""{_RUN_STATES}, {_CHANGES.removeprefix("WITH ")}
SELECT (SELECT count(*) FROM orders) AS published, (SELECT count(*) FROM ch WHERE status = 'pending') AS pending_reviews,
 count(*) FILTER (status = 'running') AS running_runs, count(*) FILTER (status = 'failed') AS failed_runs FROM x""")
def report_counters(t: Tables):
    return _report(t).counters


@query("b04_newest_restaurants", """
WITH p AS (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)
SELECT o_orderkey AS restaurant_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS menu_item_count, (SELECT count(*) FROM orders) AS total FROM p""")
def newest_restaurants(t: Tables):
    return _report(t).newest.select("restaurant_id", "menu_item_count", "total")
