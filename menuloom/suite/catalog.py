"""Queries for trees, listings, counts, differences and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delta, leaves, listing, rules, tree
from .base import Tables, query, sql_collapse, with_dishes
from .validation import KEYS, _RULES

# --- trees ----------------------------------------------------------------------

@query("s05_tree_paths", """
SELECT 'r' || r_regionkey AS node, r_name AS path, 1 AS depth FROM region
UNION ALL SELECT 'n' || n_nationkey, r_name || '.' || n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'c' || c_custkey, r_name || '.' || n_name || '.' || c_name, 3 FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey""")
def tree_paths(t: Tables):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = (
        t.region.select(s("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
        .unionByName(t.nation.select(s("n", "n_nationkey").alias("node"), s("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
        .unionByName(t.customer.select(s("c", "c_custkey").alias("node"), s("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name")))
    )
    return tree.category_paths(nodes, "node", "parent", F.col("name"))[0]


@query("s05_tree_deep_chain", """
WITH d AS (SELECT DISTINCT doc_id FROM documents), n AS (SELECT 100 * (doc_id // 100) AS root, doc_id FROM d WHERE doc_id % 100 <> 50)
SELECT doc_id::VARCHAR AS node, string_agg(up::VARCHAR, '.' ORDER BY up) AS path, count(*)::INTEGER AS depth
FROM n, unnest(range(root, doc_id + 1)) AS t(up) WHERE doc_id % 100 < 50 GROUP BY 1""")
def deep_chain(t: Tables):
    """Documents as chains of up to fifty nodes; the fifty-first of each hundred is missing,
    so what hangs on it has no root."""
    k = F.col("doc_id")
    nodes = t.documents.where(k % 100 != 50).select(k.cast("string").alias("node"), F.when(k % 100 != 0, (k - 1).cast("string")).alias("parent"))
    return tree.category_paths(nodes.distinct(), "node", "parent", F.col("node"))[0]


def _exports(t: Tables):
    """nation = restaurant, customer = menu, order = category, part and supplier of a line = dish."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("category_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("pos"), "l_partkey", "l_returnflag")
    return {
        "restaurants": t.nation.select(F.col("n_nationkey").alias("restaurant_id"), "n_name"),
        "locations": t.supplier.select(F.col("s_nationkey").alias("restaurant_id"), F.col("s_suppkey").alias("pos"), "s_name"),
        "menus": t.customer.select(F.col("c_custkey").alias("menu_id"), F.col("c_nationkey").alias("restaurant_id"), F.col("c_custkey").alias("pos"), "c_name"),
        "categories": t.orders.select(F.col("o_orderkey").alias("category_id"), F.col("o_custkey").alias("menu_id"), F.col("o_orderkey").alias("pos"), F.lit(None).cast("long").alias("parent_id"), "o_orderstatus"),
        "dishes": lines,
    }


@query("s04_assemble_tree", """
WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
e AS (SELECT c_nationkey, count(DISTINCT c_custkey) + count(DISTINCT o_orderkey) + coalesce(sum(n), 0) AS entries
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_nationkey AS restaurant_id, p AS part, least(500, entries - 500 * p)::BIGINT AS entries FROM e, unnest(range(0, (entries::BIGINT - 1) // 500 + 1)) AS t(p)""")
def assemble(t: Tables):
    """Parts of five hundred entries each: menus and categories where they begin, and dishes."""
    menus = tree.assemble(**_exports(t), part_rows=500)["menus"]
    begun = lambda x: F.when(x.isNotNull(), 1).otherwise(0)
    entries = F.aggregate("menus", F.lit(0), lambda n, m: n + begun(m["menu"]) + F.aggregate(
        m["categories"], F.lit(0), lambda k, c: k + begun(c["category"]) + F.size(c["dishes"])))
    return menus.select("restaurant_id", "part", entries.cast("long").alias("entries"))


@query("s05_shred_tree", """
SELECT l_orderkey AS category_id, l_linenumber * 1000000 + l_suppkey AS pos, l_partkey, l_returnflag FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey)""")
def shred(t: Tables):
    return tree.shred_all(tree.assemble(**_exports(t), part_rows=500))["dishes"]


@query("s05_shred_menus", "SELECT c_nationkey AS restaurant_id, c_custkey AS pos, c_custkey AS menu_id, c_name FROM customer")
def shred_menus(t: Tables):
    return tree.shred_all(tree.assemble(**_exports(t), part_rows=500))["menus"]


@query("s05_shred_locations", "SELECT s_nationkey AS restaurant_id, s_suppkey AS pos, s_name FROM supplier")
def shred_locations(t: Tables):
    return tree.shred_all(tree.assemble(**_exports(t), part_rows=500))["locations"]


@query("a12_top_level_dish_count", """
SELECT o_custkey AS restaurant_id, count(*)::INTEGER AS dishes FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderstatus <> 'P' GROUP BY 1""")
def top_level(t: Tables):
    lines = t.lineitem.select(F.col("l_orderkey").alias("category_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("dish"))
    categories = tree.nest(
        t.orders.select(F.col("o_orderkey").alias("category_id"), F.col("o_custkey").alias("restaurant_id"),
                        F.when(F.col("o_orderstatus") == "P", "above").alias("parent_id")),
        lines, ["category_id"], "pos", ["dish"], "dishes",
    )
    menus = tree.nest(
        t.customer.select(F.col("c_custkey").alias("restaurant_id")), categories, ["restaurant_id"], "category_id", ["parent_id", "dishes"], "categories",
    )
    counted = menus.withColumn("menus", F.array(F.struct("categories"))).select(
        "restaurant_id", tree.top_level_dish_count().alias("n")
    )
    return counted.groupBy("restaurant_id").agg(F.sum("n").cast("int").alias("dishes")).filter(F.col("dishes") > 0)


# --- listings and counts ----------------------------------------------------------

def _levels(t: Tables):
    """lineitem = dish, order = category, customer = menu, nation = restaurant."""
    return (
        t.nation.select(F.col("n_nationkey").alias("restaurant_id")),
        t.customer.select(F.col("c_custkey").alias("menu_id"), F.col("c_nationkey").alias("restaurant_id")),
        t.orders.select(F.col("o_orderkey").alias("category_id"), F.col("o_custkey").alias("menu_id")),
        t.lineitem.select(F.col("l_orderkey").alias("category_id")),
    )


@query("j01_a02_dish_count_per_restaurant", """
SELECT n_nationkey AS restaurant_id, count(l_orderkey) AS menu_item_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def dish_counts(t: Tables):
    return listing.dish_counts(*_levels(t))


@query("w05_first_city", """
SELECT o_custkey AS restaurant_id, arg_min(o_orderpriority, o_orderkey) AS city FROM orders GROUP BY 1""")
def first_city(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("restaurant_id"), F.col("o_orderpriority").alias("city"), "o_orderkey")
    return listing.first_by_id(rows, "restaurant_id", "city", "o_orderkey")


def _restaurants(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("restaurant_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("name"))


@query("l01_deep_page", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50 OFFSET 30000""")
def deep_page(t: Tables):
    order = [("l_extendedprice", True), *((c, False) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))]
    rows = listing.deep_page(t.lineitem, order, 601, 50)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")


@query("l01_a01_page_listing", """
SELECT o_orderkey AS restaurant_id, epoch_us(o_orderdate) AS created_us, (SELECT count(*) FROM orders) AS total FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100""")
def page_listing(t: Tables):
    rows = listing.page(_restaurants(t), [F.col("created_at").desc(), F.col("restaurant_id").desc()], 3, 50, with_total=True)
    return rows.select("restaurant_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"), "total")


@query("l02_recent_audit_entries", """
SELECT event_id AS id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""")
def recent(t: Tables):
    rows = t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "user_id", "event_type")
    return listing.newest(rows, 100).select("id", "user_id", "event_type")


@query("l02_recent_audit_entries_per_entity", """
SELECT event_id AS id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3""")
def recent_per_entity(t: Tables):
    from ..operators.groups import top_of_group

    rows = t.events.select(F.col("event_id").alias("id"), "ts", "user_id")
    return top_of_group(rows, ["user_id"], [F.col("ts").desc(), F.col("id").desc()], 3).select("id", "user_id")


@query("l03_pending_with_display_name", """
SELECT event_id AS id, json_extract_string(props, '$.k') AS display_name FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def pending(t: Tables):
    from ..functions.paths import json_value_at

    rows = t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "props", "event_type")
    waiting = rows.filter(F.col("event_type") == "view")
    return listing.newest(waiting, listing.DEFAULT_PENDING).select("id", json_value_at(F.col("props"), "k").alias("display_name"))


@query("l04_sorted_page", """
SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 100 OFFSET 100""")
def sorted_page(t: Tables):
    by_name = F.collate("p_name", "UNICODE")
    return listing.page(t.part.select("p_partkey", "p_name"), [by_name, F.col("p_partkey")], 2, 100)


@query("l05_restaurant_summary", """
WITH p AS (SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 200)
SELECT o_orderkey AS restaurant_id, o_orderpriority AS name, epoch_us(o_orderdate) AS created_us,
  (SELECT arg_min(l_returnflag, (l_linenumber, l_partkey)) FROM lineitem WHERE l_orderkey = o_orderkey) AS city,
  (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS menu_item_count, (SELECT count(*) FROM orders) AS total FROM p""")
def summary(t: Tables):
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("restaurant_id"), F.col("l_returnflag").alias("city"), F.struct("l_linenumber", "l_partkey").alias("location_id"),
    )
    out = listing.restaurant_summary(_restaurants(t), lines, lines.select("restaurant_id"), 3, 100)
    return out.withColumn("created_us", F.unix_micros(F.col("created_at").cast("timestamp"))).drop("created_at")


# --- differences ------------------------------------------------------------------

FIELDS = ["p_name", "p_brand", "p_size", "price", "tags"]


def _versions(t: Tables):
    k = F.col("p_partkey")
    current = t.part.select(
        k, "p_name", "p_brand", "p_size", F.col("p_retailprice").cast("decimal(10,2)").alias("price"), F.array("p_brand", "p_type").alias("tags"),
    )
    target = current.filter(k % 10 != 3).select(
        k,
        F.when(k % 6 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"),
        "p_brand",
        F.when(k % 11 != 0, F.col("p_size")).alias("p_size"),
        F.when(k % 7 == 0, F.col("price") + 1).otherwise(F.col("price")).cast("decimal(10,2)").alias("price"),
        F.when(k % 13 == 0, F.array("p_brand")).otherwise(F.reverse("tags")).alias("tags"),
    )
    added = current.filter(k % 15 == 0).withColumn("p_partkey", k + 1_000_000_000_000)
    return current, target.unionByName(added)


_VERSIONS = """
cur AS (SELECT p_partkey AS k, p_name, p_brand, p_size, p_retailprice::DECIMAL(10,2) AS price, [p_brand, p_type] AS tags FROM part),
tgt AS (SELECT k, CASE WHEN k % 6 = 0 THEN upper(p_name) ELSE p_name END AS p_name, p_brand, CASE WHEN k % 11 <> 0 THEN p_size END AS p_size,
    (CASE WHEN k % 7 = 0 THEN price + 1 ELSE price END)::DECIMAL(10,2) AS price,
    CASE WHEN k % 13 = 0 THEN [p_brand] ELSE [tags[2], tags[1]] END AS tags FROM cur WHERE k % 10 <> 3
  UNION ALL SELECT k + 1000000000000, p_name, p_brand, p_size, price, tags FROM cur WHERE k % 15 = 0)"""
_WHOLE = """'{"p_name":"' || p_name || '","p_brand":"' || p_brand || '","p_size":' || p_size || ',"price":' || price || ',"tags":["' || tags[1] || '","' || tags[2] || '"]}'"""
_JSON_LIST = "'[\"' || array_to_string({}, '\",\"') || '\"]'"
_DELTA = f"""{_VERSIONS}, j AS (SELECT a.k, a.p_name AS n0, b.p_name AS n1, a.p_size AS s0, b.p_size AS s1, a.price AS p0, b.price AS p1, a.tags AS t0, b.tags AS t1
  FROM cur a JOIN tgt b ON a.k = b.k),
delta AS (
 SELECT k AS p_partkey, NULL::VARCHAR AS field, 'added' AS op, NULL::VARCHAR AS old_value, {_WHOLE} AS new_value FROM tgt WHERE k NOT IN (SELECT k FROM cur)
 UNION ALL SELECT k, NULL, 'removed', {_WHOLE}, NULL FROM cur WHERE k NOT IN (SELECT k FROM tgt)
 UNION ALL SELECT k, 'p_name', 'changed', n0, n1 FROM j WHERE n0 <> n1
 UNION ALL SELECT k, 'p_size', 'changed', s0::VARCHAR, s1::VARCHAR FROM j WHERE s0 IS DISTINCT FROM s1
 UNION ALL SELECT k, 'price', 'changed', p0::VARCHAR, p1::VARCHAR FROM j WHERE p0 <> p1
 UNION ALL SELECT k, 'tags', 'changed', {_JSON_LIST.format('t0')}, {_JSON_LIST.format('t1')} FROM j WHERE list_sort(t0) <> list_sort(t1))"""


def _delta(t: Tables):
    current, target = _versions(t)
    return delta.table_diff(current, target, ["p_partkey"])


@query("d01_table_diff", f"WITH {_DELTA} SELECT * FROM delta")
def table_diff(t: Tables):
    return _delta(t)


_NULL_KEYS = f"""{_VERSIONS},
cut AS (SELECT CASE WHEN k % 50 = 0 THEN NULL ELSE k % 50 END AS part, k // 50 AS place, price FROM cur),
cut2 AS (SELECT CASE WHEN k % 50 = 0 THEN NULL ELSE k % 50 END AS part, k // 50 AS place, price FROM tgt)"""


@query("d01_null_keys", f"""WITH {_NULL_KEYS}
SELECT coalesce(a.part, b.part, -1) AS part, coalesce(a.place, b.place) AS place,
  CASE WHEN b.place IS NULL THEN 'removed' WHEN a.place IS NULL THEN 'added' ELSE 'changed' END AS op
FROM cut a FULL JOIN cut2 b ON a.part IS NOT DISTINCT FROM b.part AND a.place = b.place
WHERE a.place IS NULL OR b.place IS NULL OR a.price <> b.price""")
def null_keys(t: Tables):
    """A null key part is a key like any other."""
    k = F.col("p_partkey")
    current, target = (v.select(F.when(k % 50 != 0, k % 50).alias("part"), F.floor(k / 50).alias("place"), "price") for v in _versions(t))
    return delta.table_diff(current, target, ["part", "place"], ["price"]).select(F.coalesce("part", F.lit(-1)).alias("part"), "place", "op")


# Customers with their orders and lines as one nested row each, and a second version of them.
_TREES = """
cust AS (SELECT c_custkey AS k, c_name, c_nationkey::VARCHAR AS c_phone, c_mktsegment FROM customer),
ords AS (SELECT o_custkey AS k, o_orderkey AS o, o_orderstatus AS st, o_orderpriority AS pr, o_totalprice::DECIMAL(12,2)::VARCHAR AS price FROM orders),
lins AS (SELECT o_custkey AS k, l_orderkey AS o, l_linenumber AS l, sum(l_quantity::BIGINT)::BIGINT AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
live AS (SELECT k FROM cust WHERE k % 17 <> 0),
kept AS (SELECT ords.* FROM ords JOIN live USING (k) WHERE o % 11 <> 0)"""


@query("d01_leaf_diff", f"""WITH {_TREES}
SELECT k AS c_custkey, NULL::VARCHAR AS path, 'removed' AS op, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value, 1::BIGINT AS copies FROM cust WHERE k % 17 = 0
UNION ALL SELECT k, 'profile.contact.phone', 'changed', c_phone, 'n' || c_phone, 1 FROM cust JOIN live USING (k) WHERE k % 4 = 0
UNION ALL SELECT k, 'profile.segment', 'changed', c_mktsegment, NULL, 1 FROM cust JOIN live USING (k) WHERE k % 6 = 0
UNION ALL SELECT k, 'orders[id=' || o || ']', 'removed', NULL, NULL, 1 FROM ords JOIN live USING (k) WHERE o % 11 = 0
UNION ALL SELECT k, 'orders[id=' || o || '].status', 'changed', st, st || '!', 1 FROM kept WHERE o % 7 = 0
UNION ALL SELECT k, 'orders[id=' || o || '].marks[]', 'removed', st, NULL, 1 FROM kept WHERE o % 3 = 0
UNION ALL SELECT k, 'orders[id=' || o || '].marks[]', 'added', NULL, 'new', 2 FROM kept WHERE o % 5 = 0
UNION ALL SELECT k, 'orders[id=' || o || '].lines[id=' || l || ']', 'removed', NULL, NULL, 1 FROM lins JOIN kept USING (k, o) WHERE (o + l) % 13 = 0
UNION ALL SELECT k, 'orders[id=' || o || '].lines[id=' || l || '].qty', 'changed', qty::VARCHAR, (qty + 1)::VARCHAR, 1 FROM lins JOIN kept USING (k, o) WHERE (o + l) % 13 <> 0 AND (o + l) % 5 = 0""")
def nested_leaf_diff(t: Tables):
    """Leaves at four depths, lists in another order and with repeats. The JSON of whole items is left out."""
    o, l, k = F.col("o"), F.col("l"), F.col("c_custkey")
    # Dealt by order once, as lines are grouped by it and meet their order by it.
    dealt = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").repartition("l_orderkey")
    lines = dealt.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l")).agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"))

    def trees(lines, orders, customers, down: bool):
        inner = lines.groupBy("o").agg(F.sort_array(F.collect_list(F.struct(l.alias("id"), "qty")), not down).alias("lines"))
        full = orders.join(inner, "o", "left").groupBy("c_custkey").agg(F.sort_array(F.collect_list(F.struct(o.alias("id"), "status", "marks", "lines")), not down).alias("orders"))
        return customers.join(full, "c_custkey", "left")

    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("o"), status.alias("status"), F.array(status, status, priority).alias("marks"))
    profile = lambda phone, segment: F.struct(F.col("c_name").alias("name"), F.struct(phone.alias("phone")).alias("contact"), segment.alias("segment")).alias("profile")
    phone, segment = F.col("c_nationkey").cast("string"), F.col("c_mktsegment")
    current = trees(lines, orders, t.customer.select(k, profile(phone, segment)), False)
    marks = F.concat(
        F.array(F.element_at("marks", 3), F.element_at("marks", 1)), F.when(o % 3 != 0, F.slice("marks", 2, 1)).otherwise(F.array().cast("array<string>")),
        F.when(o % 5 == 0, F.array(F.lit("new"), F.lit("new"))).otherwise(F.array().cast("array<string>")),
    )
    changed = orders.filter(o % 11 != 0).select("c_custkey", o, F.when(o % 7 == 0, F.concat("status", F.lit("!"))).otherwise(F.col("status")).alias("status"), marks.alias("marks"))
    fewer = lines.filter((o + l) % 13 != 0).withColumn("qty", F.when((o + l) % 5 == 0, F.col("qty") + 1).otherwise(F.col("qty")))
    people = t.customer.filter(k % 17 != 0).select(k, profile(F.when(k % 4 == 0, F.concat(F.lit("n"), phone)).otherwise(phone), F.when(k % 6 != 0, segment)))
    found = leaves.leaf_diff(current, trees(fewer, changed, people, True), ["c_custkey"])
    whole = F.col("path").isNull() | (F.col("path").endswith("]") & ~F.col("path").endswith("[]"))
    return found.select("c_custkey", "path", "op", *[F.when(~whole, F.col(c)).alias(c) for c in ("old_value", "new_value")], "copies")


_NAT = f"""keyed AS (SELECT *, lower({sql_collapse('name')}) AS name_key FROM dishes),
cur AS (SELECT restaurant_id, menu_pos, name_key, row_number() OVER (PARTITION BY restaurant_id, menu_pos, name_key ORDER BY dish_id) AS occurrence, price FROM keyed),
tgt AS (SELECT restaurant_id, menu_pos, name_key, row_number() OVER (PARTITION BY restaurant_id, menu_pos, name_key ORDER BY dish_id) AS occurrence,
  CASE WHEN dish_id % 8 = 5 THEN 1.25::DECIMAL(10,2) ELSE price END AS price FROM keyed WHERE dish_id % 9 <> 4)"""


@query("d01_natural_key_diff", with_dishes(f""", {_NAT}
SELECT coalesce(a.restaurant_id, b.restaurant_id) AS restaurant_id, coalesce(a.menu_pos, b.menu_pos) AS menu_pos, coalesce(a.name_key, b.name_key) AS name_key,
  coalesce(a.occurrence, b.occurrence) AS occurrence, CASE WHEN b.restaurant_id IS NULL THEN 'removed' WHEN a.restaurant_id IS NULL THEN 'added' ELSE 'changed' END AS op
FROM cur a FULL JOIN tgt b ON a.restaurant_id = b.restaurant_id AND a.menu_pos = b.menu_pos AND a.name_key = b.name_key AND a.occurrence = b.occurrence
WHERE a.restaurant_id IS NULL OR b.restaurant_id IS NULL OR a.price IS DISTINCT FROM b.price"""))
def natural_key_diff(t: Tables):
    """A re-extraction with all-new ids still pairs with its live rows."""
    scope, key = ["restaurant_id", "menu_pos"], ["restaurant_id", "menu_pos", "name_key", "occurrence"]
    rows = t.dishes.select("restaurant_id", "menu_pos", "name", "dish_id", "price")
    fresh = rows.filter(F.col("dish_id") % 9 != 4).withColumn(
        "price", F.when(F.col("dish_id") % 8 == 5, F.lit("1.25").cast("decimal(10,2)")).otherwise(F.col("price"))
    )
    current = delta.with_natural_key(rows, scope, ["dish_id"])
    target = delta.with_natural_key(fresh, scope, ["dish_id"])
    return delta.table_diff(current, target, key, ["price"]).select(*key, "op")


@query("d03_touched_keys", f"WITH {_DELTA} SELECT DISTINCT p_partkey FROM delta WHERE op <> 'removed'")
def touched(t: Tables):
    return delta.touched_keys(_delta(t), ["p_partkey"])


_NULL_SIDE = "SELECT k AS p_partkey, coalesce(array_to_string(tags, '|'), '') AS tags, p_name, coalesce(p_size, -1) AS p_size, price::VARCHAR AS price FROM "


@query("d05_patch_rows", f"WITH {_VERSIONS} {_NULL_SIDE} (SELECT c.* REPLACE (CASE WHEN c.p_name = x.p_name AND c.p_size IS NOT DISTINCT FROM x.p_size AND c.price = x.price AND c.k % 13 <> 0 THEN c.tags ELSE x.tags END AS tags, x.p_name AS p_name, x.p_size AS p_size, x.price AS price) FROM cur c JOIN tgt x ON c.k = x.k UNION ALL SELECT * FROM tgt WHERE k >= 1000000000000)")
def patch_rows(t: Tables):
    current, target = _versions(t)
    patched = delta.patch_rows(current, target, _delta(t), ["p_partkey"])
    return patched.select("p_partkey", F.array_join("tags", "|").alias("tags"), "p_name", F.coalesce("p_size", F.lit(-1)).alias("p_size"), F.col("price").cast("string").alias("price"))


@query("d05_patch_law", "SELECT p_partkey, '' AS field, '' AS op, '' AS old_value, '' AS new_value FROM part WHERE false")
def patch_law(t: Tables):
    """diff(patch(current), target) is empty."""
    current, target = _versions(t)
    patched = delta.patch_rows(current, target, delta.table_diff(current, target, ["p_partkey"]), ["p_partkey"])
    return delta.table_diff(patched, target, ["p_partkey"])


@query("d05_patch_fields", """
SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'new ' || p_brand ELSE p_brand END AS description, p_type AS logo_url, p_size::VARCHAR AS phone FROM part""")
def patch_fields(t: Tables):
    k = F.col("p_partkey")
    current = t.part.select(k, F.col("p_brand").alias("description"), F.col("p_type").alias("logo_url"), F.col("p_size").cast("string").alias("phone"))
    target = current.select(
        k, F.when(k % 6 == 0, F.concat(F.lit("new "), "description")).otherwise(F.col("description")).alias("description"), "logo_url",
        F.when(k % 5 == 0, "0").otherwise(F.col("phone")).alias("phone"),
    )
    return delta.patch_fields(current, target, delta.table_diff(current, target, ["p_partkey"]), ["p_partkey"])


@query("j10_provenance", f"""WITH {_DELTA}
SELECT p_partkey, field, op, CASE WHEN op = 'removed' THEN '' WHEN p_partkey % 2 = 0 THEN 'row' || p_partkey
  WHEN field = 'description' AND (p_partkey // 100) % 3 <> 0 THEN 'profile' || (p_partkey // 100) ELSE '' END AS refs
FROM (SELECT p_partkey, CASE field WHEN 'price' THEN 'description' ELSE field END AS field, op FROM delta)""")
def provenance(t: Tables):
    k = F.col("p_partkey")
    changes = _delta(t).withColumn("entity", F.floor(k / 100).cast("long")).withColumn(
        "field", F.when(F.col("field") == "price", "description").otherwise(F.col("field"))
    )
    rows = changes.select(k).distinct().filter(k % 2 == 0).withColumn("source_snapshot_ids", F.array(F.concat(F.lit("row"), k.cast("string"))))
    profiles = changes.select("entity").distinct().filter(F.col("entity") % 3 != 0).withColumn(
        "source_snapshot_ids", F.array(F.concat(F.lit("profile"), F.col("entity").cast("string")))
    )
    out = delta.with_provenance(changes, rows, profiles, ["p_partkey"], "entity")
    return out.select(k, "field", "op", F.array_join("source_snapshot_ids", ",").alias("refs"))


_PRICE_CASES = " UNION ALL ".join(
    f"SELECT restaurant_id, dish_id, '{code}' AS code, '{sev}' AS severity FROM dishes WHERE {test}" for _, code, sev, test in _RULES["v09_price_bounds"][1]
)
_TOUCH = "SELECT dish_id FROM dishes WHERE dish_id % 4 = 1"


def _price_issues(t: Tables):
    issues = rules.dish_issues(t.dishes, KEYS, rules.price_rules()).filter(F.col("code").isin("implausible_price", "zero_price"))
    whole = t.dishes.select("restaurant_id").distinct().select(
        "restaurant_id", F.lit(None).cast("long").alias("dish_id"), F.lit("locations").alias("field_path"),
        F.lit("missing_locations").alias("code"), F.lit("warning").alias("severity"), F.lit("none").alias("message"),
    )
    touched = t.dishes.filter(F.col("dish_id") % 4 == 1).select("dish_id")
    return issues.unionByName(whole), touched


@query("j09_scoped_issues", with_dishes(f""", i AS ({_PRICE_CASES})
SELECT restaurant_id, dish_id, code FROM i WHERE dish_id IN ({_TOUCH})
UNION ALL SELECT DISTINCT restaurant_id, -1::BIGINT, 'missing_locations' FROM dishes"""))
def scoped(t: Tables):
    issues, touched = _price_issues(t)
    return delta.scoped_issues(issues, touched, ["dish_id"]).select(
        "restaurant_id", F.coalesce("dish_id", F.lit(-1)).alias("dish_id"), "code"
    )


@query("d04_scoped_report", with_dishes(f""", i AS ({_PRICE_CASES}), r AS (SELECT DISTINCT restaurant_id FROM dishes)
SELECT restaurant_id, (SELECT count(*) FROM i WHERE i.restaurant_id = r.restaurant_id AND severity = 'error') AS errors,
 (SELECT count(*) FROM i WHERE i.restaurant_id = r.restaurant_id AND severity = 'warning') + 1 AS warnings,
 (SELECT count(*) FROM i WHERE i.restaurant_id = r.restaurant_id) + 1 AS issue_count,
 (SELECT count(*) FROM i WHERE i.restaurant_id = r.restaurant_id AND severity = 'error') = 0 AS is_valid,
 (SELECT count(*) FROM i WHERE i.restaurant_id = r.restaurant_id AND dish_id IN ({_TOUCH})) + 1 AS reported_issues FROM r"""))
def scoped_report(t: Tables):
    issues, touched = _price_issues(t)
    return delta.scoped_report(t.dishes.select("restaurant_id").distinct(), issues, touched, "restaurant_id", ["dish_id"])
