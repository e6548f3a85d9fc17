"""Queries for URLs, hosts, source choice, captured pages and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import uuid5_url
from ..functions.urls import host_of, is_ip_literal, domain_of, with_canonical_url
from ..operators import authority, pages as pg
from ..sources import snapshots as snap
from .base import Tables, query

def k():
    return F.col("page_id")


# Raw spellings of each page's URL, by page_id modulo 9.
def _raw(url):
    return (
        F.when(k() % 9 == 1, F.replace(url, F.lit("://"), F.lit("://user:pw@")))
        .when(k() % 9 == 2, F.concat(F.lit("  "), url, F.lit("\t ")))
        .when(k() % 9 == 3, F.regexp_replace(url, "(://[^/]*)", "$1:443"))
        .when(k() % 9 == 4, F.regexp_replace(url, "^https?", "ftp"))
        .when(k() % 9 == 5, F.regexp_replace(url, "^https?://", ""))
        .when(k() % 9 == 6, F.concat(F.regexp_replace(url, "[?#].*$", ""), F.lit("?q=a%20b+c~*&UTM_x=1&gclid=2&e=&%zz=é")))
        .when(k() % 9 == 7, F.lit("http://10.0.0.7/x"))
        .when(k() % 9 == 8, F.lit("https:///none"))
        .otherwise(F.concat(F.upper(F.regexp_extract(url, "^[a-z]+://[^/]*", 0)), F.regexp_extract(url, "^[a-z]+://[^/]*(.*)$", 1)))
    )


_PARTS = """
parts AS (SELECT page_id, url, page_id % 9 AS m, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
  regexp_extract(url, '://([^/?#]*)', 1) AS host,
  regexp_replace(regexp_extract(url, '://[^/]*([^?#]*)', 1), '(.)/+$', '\\1') AS path,
  regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages),
cleaned AS (SELECT *, CASE WHEN m = 6 THEN 'q=a+b+c~%2A&e=&%25zz=%C3%A9' WHEN query LIKE 'utm_%' THEN '' ELSE query END AS kept,
  CASE m WHEN 5 THEN 'https' ELSE scheme END AS to_scheme,
  CASE WHEN m = 3 AND scheme = 'http' THEN host || ':443' ELSE host END AS netloc FROM parts),
canonical AS (SELECT *, to_scheme || '://' || netloc || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS good,
  CASE m WHEN 4 THEN 'unsupported_scheme' WHEN 7 THEN 'ip_literal' WHEN 8 THEN 'no_hostname' END AS reason FROM cleaned)"""


@query("f01_canonical_url", f"""WITH {_PARTS}
SELECT page_id, CASE WHEN reason IS NULL THEN good END AS canonical_url, reason AS reject_reason FROM canonical""")
def canonical(t: Tables):
    raw = t.pages.select("page_id", _raw(F.col("url")).alias("raw"))
    return with_canonical_url(raw, "raw").drop("raw")


@query("f01_equivalent_urls", f"""WITH {_PARTS},
plain AS (SELECT scheme || '://' || host || path || CASE WHEN query LIKE 'utm_%' OR query = '' THEN '' ELSE '?' || query END AS u FROM parts)
SELECT canonical_url, count(*) AS equivalent_rows FROM (
  SELECT good AS canonical_url FROM canonical WHERE reason IS NULL UNION ALL SELECT u FROM plain) GROUP BY 1""")
def equivalent(t: Tables):
    both = t.pages.select(_raw(F.col("url")).alias("raw")).unionByName(t.pages.select(F.col("url").alias("raw")))
    return authority.canonical_group_sizes(with_canonical_url(both, "raw"))


@query("p07_domain_boundary", """
SELECT page_id, regexp_replace(host, '^www\\.', '') = verified AS inside FROM (
  SELECT page_id, host, CASE WHEN page_id % 3 = 0 THEN regexp_replace(host, '^(www|m|blog)\\.', '') ELSE host END AS raw_verified,
    regexp_replace(raw_verified, '^www\\.', '') AS verified
  FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages))""")
def boundary(t: Tables):
    host = host_of(F.col("url"))
    verified = F.when(k() % 3 == 0, F.regexp_replace(host, r"^(www|m|blog)\.", "")).otherwise(F.upper(host))
    return t.pages.select("page_id", pg.is_inside_domain(F.col("url"), verified).alias("inside"))


@query("p08_ip_literal_host", """
SELECT c_custkey, c_custkey % 5 IN (0, 2, 3) AND NOT (c_custkey % 5 = 0 AND c_custkey % 400 > 255) AS is_ip FROM customer""")
def ip_literal(t: Tables):
    k = F.col("c_custkey")
    host = (
        F.when(k % 5 == 0, F.concat_ws(".", (k % 400).cast("string"), F.lit("0.10"), (k % 7).cast("string")))
        .when(k % 5 == 1, F.concat_ws(".", F.lit("1.2.3"), F.concat(F.lit("0"), (k % 10).cast("string"))))
        .when(k % 5 == 2, F.concat(F.lit("[2001:db8::"), F.lower(F.hex(k)), F.lit("]")))
        .when(k % 5 == 3, F.concat(F.lit("::"), F.lower(F.hex(k))))
        .otherwise(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))))
    )
    return t.customer.select("c_custkey", is_ip_literal(host).alias("is_ip"))


LISTED = ("free-bets.example.com", "example.net")
_LISTED_TEST = "(d = 'free-bets.example.com' OR d LIKE '%.free-bets.example.com' OR d = 'example.net' OR d LIKE '%.example.net')"


@query("p09_official_domain", f"""WITH {_PARTS}, o AS (SELECT *, regexp_replace(host, '^www\\.', '') AS d FROM canonical)
SELECT page_id, CASE WHEN reason IS NULL AND NOT {_LISTED_TEST} THEN good END AS official_url,
  CASE WHEN reason IS NULL AND NOT {_LISTED_TEST} THEN d END AS verified_domain,
  coalesce(reason, CASE WHEN {_LISTED_TEST} THEN 'aggregator' END) AS reject_reason FROM o""")
def official(t: Tables):
    raw = t.pages.select("page_id", _raw(F.col("url")).alias("raw"))
    checked = authority.validate_official_domain(raw, "raw", LISTED)
    return checked.select(
        "page_id", "official_url",
        F.when(F.col("reject_reason").isNull(), F.col("domain")).alias("verified_domain"), "reject_reason",
    )


@query("j04_blocked_hosts", f"""SELECT page_id FROM (SELECT page_id, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\\.', '') AS d
 FROM pages) WHERE NOT {_LISTED_TEST.replace("'example.net'", "'ththth.example.net'").replace("%.example.net", "%.ththth.example.net")}""")
def blocked(t: Tables):
    """Pages whose host no suffix rule covers; the blocklist is a table."""
    rows = t.pages.select("page_id", domain_of(F.col("url")).alias("domain"))
    blocklist = t.spark.createDataFrame([("free-bets.example.com",), ("ththth.example.net",), ("com",)], "domain string")
    return authority.without_listed(rows, "domain", blocklist).select("page_id")


# --- candidates: four neighbouring pages are one entity's candidates ----------

def _candidates(t: Tables):
    return t.pages.select(
        F.floor(k() / 4).cast("long").alias("restaurant_id"), (k() % 4).cast("int").alias("pos"),
        _raw(F.col("url")).alias("url"), ((k() * 37 % 21) * 5).alias("percent"),
    ).withColumn("provider_confidence", F.col("percent") / F.lit(100.0)).withColumn("provider_name", F.lit("pages"))


_CAND = f"""{_PARTS}, c AS (SELECT page_id // 4 AS restaurant_id, page_id % 4 AS pos, (page_id * 37 % 21) * 5 AS percent, good,
  reason IS NULL AND NOT {_LISTED_TEST} AS valid FROM (SELECT *, regexp_replace(host, '^www\\.', '') AS d FROM canonical)),
r AS (SELECT *, row_number() OVER (PARTITION BY restaurant_id ORDER BY percent DESC, pos) AS rn FROM c),
w AS (SELECT restaurant_id, min(rn) FILTER (valid) AS win FROM r GROUP BY 1)"""


@query("w04_best_candidate", f"""WITH {_CAND}
SELECT r.restaurant_id, good AS official_url, percent::INTEGER AS percent FROM r JOIN w ON r.restaurant_id = w.restaurant_id AND rn = win""")
def best_candidate(t: Tables):
    winner, _ = authority.choose_candidates(_candidates(t), listed=LISTED)
    return winner.select("restaurant_id", "official_url", F.round(F.col("provider_confidence") * 100).cast("int").alias("percent"))


@query("w04_rejected_above_winner", f"""WITH {_CAND}
SELECT r.restaurant_id, pos::INTEGER AS pos FROM r JOIN w USING (restaurant_id) WHERE NOT valid AND (win IS NULL OR rn < win)""")
def rejected(t: Tables):
    return authority.choose_candidates(_candidates(t), listed=LISTED)[1].select("restaurant_id", "pos")


@query("d11_source_resolution", f"""WITH {_CAND},
e AS (SELECT DISTINCT page_id // 4 AS restaurant_id FROM pages UNION SELECT DISTINCT -1 - page_id // 8 FROM pages),
j AS (SELECT e.restaurant_id, any_value(r.restaurant_id) IS NOT NULL AS seen, max(good) FILTER (rn = win) AS resolved_url,
  max(percent) FILTER (rn = win) AS p, count(*) FILTER (NOT valid AND (win IS NULL OR rn < win)) AS rejected_candidates
  FROM e LEFT JOIN r USING (restaurant_id) LEFT JOIN w USING (restaurant_id) GROUP BY 1)
SELECT restaurant_id, CASE WHEN NOT seen THEN 'not_found' WHEN p IS NULL THEN 'rejected' WHEN p >= 75 THEN 'verified' ELSE 'needs_review' END AS status,
  CASE WHEN p >= 75 THEN 'high' WHEN p >= 50 THEN 'medium' WHEN p IS NOT NULL THEN 'low' END AS confidence, resolved_url, rejected_candidates,
  CASE WHEN NOT seen THEN 'no_candidates' WHEN p IS NULL THEN 'all_rejected'
    WHEN p < 75 THEN 'low_confidence' END AS reason FROM j""")
def resolution(t: Tables):
    ids = t.pages.select(F.floor(k() / 4).cast("long").alias("restaurant_id"))
    unknown = t.pages.select((F.lit(-1) - F.floor(k() / 8)).cast("long").alias("restaurant_id"))
    return authority.resolve_sources(ids.unionByName(unknown).distinct(), _candidates(t), listed=LISTED)


# --- sources and snapshots ------------------------------------------------------

def _sources(t: Tables):
    return t.events.select(
        F.col("user_id").alias("restaurant_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"),
        F.when(F.col("event_type").isin("view", "click"), "restaurant_website").otherwise("pdf_menu").alias("source_type"),
        F.concat(F.lit("https://site"), F.col("event_id").cast("string"), F.lit(".example.com/")).alias("url"),
        ((F.col("event_id") % 3 == 0) & (F.col("user_id") % 4 != 0)).alias("is_verified_domain"),
    )


_LATEST = """s AS (SELECT user_id AS restaurant_id, max_by(event_id, (ts, event_id)) AS id FROM events
  WHERE event_type IN ('view', 'click') AND event_id % 3 = 0 AND user_id % 4 <> 0 GROUP BY 1)"""


@query("w01_latest_verified_website", f"WITH {_LATEST} SELECT restaurant_id, 'https://site' || id || '.example.com/' AS url FROM s")
def latest_website(t: Tables):
    return authority.latest_verified_website(_sources(t)).select("restaurant_id", "url")


@query("w01_latest_snapshot", """
SELECT source AS source_id, arg_max(doc_id, doc_id) AS id, arg_max(sha256(text), doc_id) AS content_hash
FROM documents WHERE lang IN ('en', 'de') GROUP BY 1""")
def latest_snapshot(t: Tables):
    snapshots = t.documents.select(
        F.col("source").alias("source_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("fetched_at"),
        F.sha2("text", 256).alias("content_hash"), F.when(F.col("lang").isin("en", "de"), "html").otherwise("pdf").alias("content_type"),
    )
    return authority.latest_snapshot(snapshots, "html").select("source_id", "id", "content_hash")


@query("j03_current_source", f"""WITH {_LATEST}
SELECT u.restaurant_id, CASE WHEN s.id IS NOT NULL THEN 'https://site' || s.id || '.example.com/'
   WHEN u.restaurant_id % 8 = 0 THEN 'https://hint' || u.restaurant_id || '.example.com/' END AS url,
  CASE WHEN s.id IS NOT NULL THEN 'stored' WHEN u.restaurant_id % 8 = 0 THEN 'hint' END AS origin
FROM (SELECT DISTINCT user_id AS restaurant_id FROM events) u LEFT JOIN s USING (restaurant_id)""")
def current_source(t: Tables):
    users = t.events.select(F.col("user_id").alias("restaurant_id")).distinct()
    hints = users.select(
        "restaurant_id", F.concat(F.lit("https://hint"), F.col("restaurant_id").cast("string"), F.lit(".example.com/")).alias("url"),
        (F.col("restaurant_id") % 8 == 0).alias("is_verified_domain"),
    )
    return authority.current_source(users, _sources(t), hints)


@query("s02_snapshot_capture", """
SELECT page_id AS source_id, kind AS content_type, sha256(html) AS content_hash, octet_length(encode(html)) AS content_length_bytes,
  page_id || '/' || sha256(html) || '.' || ext AS storage_path FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' ELSE 'screenshot' END AS kind,
  CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' ELSE 'png' END AS ext FROM pages)""")
def capture(t: Tables):
    kind = F.when(k() % 3 == 0, "html").when(k() % 3 == 1, "pdf").otherwise("screenshot")
    return snap.capture(t.pages, "page_id", "html", kind)


@query("s03_snapshot_text", """
SELECT page_id, sha256(html || CASE WHEN page_id % 5 = 0 THEN chr(65533) ELSE '' END) AS text_hash FROM pages WHERE page_id % 3 <> 1""")
def read_back(t: Tables):
    stored = t.pages.select(
        "page_id", F.when(k() % 3 == 1, "pdf").otherwise("html").alias("content_type"),
        F.when(k() % 5 == 0, F.concat(F.col("html").cast("binary"), F.unhex(F.lit("FF")))).otherwise(F.col("html").cast("binary")).alias("content"),
    )
    return snap.as_text(stored, "content").select("page_id", F.sha2("text", 256).alias("text_hash"))


# The digest of the name space for addresses followed by the name, with the version and
# variant digits set.
@query("f05_stable_ids", """
WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('seed:' || c_name)) AS h FROM customer)
SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
  || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def stable_ids(t: Tables):
    """Name-based ids."""
    return t.customer.select("c_custkey", uuid5_url(F.concat(F.lit("seed:"), "c_name")).alias("id"))


# --- pages ----------------------------------------------------------------------

@query("p03_content_type", """
SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'pdf' ELSE 'html' END AS content_type FROM pages""")
def content_type(t: Tables):
    header = F.when(k() % 4 == 0, "text/html; charset=utf-8").when(k() % 4 == 1, "Application/PDF").when(k() % 4 == 2, "")
    return t.pages.select("page_id", pg.content_type(header).alias("content_type"))


@query("p04_thin_page", "SELECT page_id, octet_length(encode(html)) < 8000 AS thin FROM pages")
def thin(t: Tables):
    return t.pages.select("page_id", pg.is_thin_page(F.lit("html"), F.col("html")).alias("thin"))


@query("p05_challenge_page", """
SELECT page_id, page_id % 5 IN (1, 2) AND (page_id % 7 = 0 OR page_id % 7 = 1 OR (page_id % 7 = 2) OR
  contains(html, 'Just a moment...')) AS challenge FROM pages""")
def challenge(t: Tables):
    status = F.when(k() % 5 == 1, 403).when(k() % 5 == 2, 503).otherwise(200)
    server = F.when(k() % 7 == 0, "CloudFlare-nginx").when(k() % 7 == 3, "nginx")
    mitigated = F.when(k() % 7 == 1, "challenge")
    body = F.when(k() % 7 == 2, F.concat("html", F.lit("<i>cf_chl_opt</i>"))).when(k() % 7 == 4, F.concat("html", F.lit("JUST A MOMENT..."))).otherwise(F.col("html"))
    return t.pages.select("page_id", pg.is_challenge_page(status, server, mitigated, body).alias("challenge"))


WORDS = ("the", "de", "ion")
_ANCHORS = """
found AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
  regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages),
anchors AS (SELECT page_id, url, unnest(hrefs) AS href, unnest(texts) AS text, unnest(range(len(hrefs))) AS pos FROM found)"""
_WORD_TEST = "(" + " OR ".join(f"contains(lower(href), '{w}') OR contains(lower(text), '{w}')" for w in WORDS) + ")"


@query("u01_page_metadata", """
SELECT page_id, trim(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&middot;', '·'), '&amp;', '&')) AS title,
  NULL::VARCHAR AS description, NULL::VARCHAR AS canonical_url, NULL::VARCHAR AS og_title, NULL::VARCHAR AS og_description, NULL::VARCHAR AS og_image FROM pages""")
def metadata(t: Tables):
    parsed = pg.parse_pages(t.pages, ["page_id"])
    return pg.page_metadata(parsed)


@query("p06_link_words", f"WITH {_ANCHORS} SELECT page_id, pos::INTEGER AS pos, href FROM anchors WHERE {_WORD_TEST}")
def link_words(t: Tables):
    anchors = pg.page_anchors(pg.parse_pages(t.pages, ["page_id"]), ["page_id"])
    return anchors.filter(pg.has_link_word(F.col("href"), F.col("text"), WORDS)).select("page_id", "pos", "href")


_INSIDE = f"""{_ANCHORS}, hits AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || href AS absolute_url, min(pos) AS pos
  FROM anchors WHERE {_WORD_TEST} AND page_id % 10 <> 9 GROUP BY ALL)"""


@query("u02_discovered_links", f"""WITH {_INSIDE}
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::INTEGER AS rank, absolute_url FROM hits
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 2""")
def discovered(t: Tables):
    domain = F.when(k() % 10 == 9, "elsewhere.example.com").otherwise(domain_of(F.col("url")))
    rows = t.pages.withColumn("domain", domain)
    parsed = pg.parse_pages(rows, ["page_id", "domain"])
    return pg.discover_links(parsed, ["page_id"], "domain", WORDS, 2)


@query("w06_links_per_host", f"""WITH {_ANCHORS}, h AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS host, href AS absolute_url, min(page_id * 100 + pos) AS pos FROM anchors GROUP BY ALL)
SELECT host, absolute_url, pos FROM h QUALIFY row_number() OVER (PARTITION BY host ORDER BY pos) <= 10""")
def links_per_host(t: Tables):
    rows = t.pages.withColumn("host", host_of(F.col("url")))
    anchors = pg.page_anchors(pg.parse_pages(rows, ["host", "page_id"]), ["host", "page_id"])
    links = anchors.select("host", F.col("href").alias("absolute_url"), (k() * 100 + F.col("pos")).alias("pos"))
    return pg.first_links(links, ["host"])


@query("j11_access_rules", """
WITH p AS (SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS host, regexp_extract(url, '://[^/]*(.*)$', 1) AS path FROM pages),
rules AS (SELECT host, page_id AS seq, page_id % 3 = 0 AS allow, regexp_extract(path, '^/[a-z]*/[0-9]', 0) AS prefix FROM p WHERE page_id % 2 = 0
  UNION ALL SELECT DISTINCT host, 1000000000, false, '/fr' FROM p)
SELECT p.page_id, coalesce(arg_min(allow, seq), true) AS allowed FROM p LEFT JOIN rules ON p.host = rules.host AND starts_with(p.path, prefix)
GROUP BY p.page_id""")
def access_rules(t: Tables):
    pages = t.pages.select("page_id", host_of(F.col("url")).alias("host"), F.regexp_extract("url", "://[^/]*(.*)$", 1).alias("path"))
    rules = pages.filter(k() % 2 == 0).select(
        F.col("host").alias("domain"), F.col("page_id").alias("seq"), (k() % 3 == 0).alias("allow"),
        F.regexp_extract("path", "^/[a-z]*/[0-9]", 0).alias("path"),
    ).unionByName(
        pages.select(F.col("host").alias("domain")).distinct().select(
            "domain", F.lit(1000000000).cast("long").alias("seq"), F.lit(False).alias("allow"), F.lit("/fr").alias("path"))
    )
    return pg.allowed_by_rules(pages, rules, "host", "path").select("page_id", "allowed")


# Numbers as paths on few hosts, and rules nested digit by digit.
@query("j11_nested_rules", """
WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN 'b' ELSE 'a' END AS host, '/' || l_orderkey || '/' || l_linenumber AS path FROM lineitem),
rules AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'b' ELSE 'a' END AS host, o_orderkey AS seq, o_orderkey % 3 = 0 AS allow,
  CASE WHEN o_orderkey % 1001 = 0 THEN '/' ELSE left('/' || o_orderkey || '/1', 3 + o_custkey % 6) END AS prefix FROM orders),
h AS (SELECT DISTINCT host, path, left(path, n) AS prefix FROM p CROSS JOIN range(1, 9) AS r(n) WHERE n <= length(path)),
v AS (SELECT h.host, h.path, coalesce(arg_min(allow, seq), true) AS allowed FROM h LEFT JOIN rules USING (host, prefix) GROUP BY 1, 2)
SELECT p.l_orderkey, p.l_linenumber, v.allowed FROM p JOIN v USING (host, path)""")
def nested_rules(t: Tables):
    number, order = F.col("l_orderkey"), F.col("o_orderkey")
    rows = t.lineitem.select(
        number, "l_linenumber", F.when(number % 5 == 0, "b").otherwise("a").alias("host"),
        F.concat(F.lit("/"), number, F.lit("/"), "l_linenumber").alias("path"),
    )
    prefix = F.substring(F.concat(F.lit("/"), order, F.lit("/1")), F.lit(1), (3 + F.col("o_custkey") % 6).cast("int"))
    rules = t.orders.select(
        F.when(order % 7 == 0, "b").otherwise("a").alias("domain"), order.alias("seq"), (order % 3 == 0).alias("allow"),
        F.when(order % 1001 == 0, "/").otherwise(prefix).alias("path"),
    )
    return pg.allowed_by_rules(rows, rules, "host", "path").select("l_orderkey", "l_linenumber", "allowed")


@query("j12_unsafe_addresses", """
WITH a AS (SELECT event_id, user_id AS host, CASE WHEN user_id % 2 = 0 THEN 100 + event_id % 120 ELSE 100 END AS o1, event_id % 256 AS o2, event_id % 97 AS o3, event_id % 4 AS f FROM events)
SELECT host, bool_or(CASE f WHEN 0 THEN false WHEN 1 THEN o2 % 2 = 1 AND host % 3 = 0
  ELSE o1 = 127 OR (o1 = 169 AND o2 = 254) OR (o1 = 172 AND o2 BETWEEN 16 AND 31) OR (o1 = 192 AND o2 = 168)
    OR (o1 = 192 AND o2 = 0 AND o3 IN (0, 2)) OR (o1 = 198 AND o2 IN (18, 19)) OR (o1 = 198 AND o2 = 51 AND o3 = 100)
    OR (o1 = 203 AND o2 = 0 AND o3 = 113) END) AS unsafe FROM a GROUP BY 1""")
def unsafe(t: Tables):
    e, u = F.col("event_id"), F.col("user_id")
    o1, o2, o3 = F.when(u % 2 == 0, 100 + e % 120).otherwise(100), e % 256, e % 97
    v4 = F.concat_ws(".", *[o.cast("string") for o in (o1, o2, o3)], F.lit("5"))
    address = (
        F.when(e % 4 == 0, F.concat(F.lit("2606:4700::"), F.lower(F.hex(o2))))
        .when((e % 4 == 1) & (o2 % 2 == 1) & (u % 3 == 0), F.concat(F.lit("fe80::"), F.lower(F.hex(o3)), F.lit(":1")))
        .when(e % 4 == 1, F.lit("2001:4860:4860::8888"))
        .when(e % 4 == 2, F.concat(F.lit("::ffff:"), v4))
        .otherwise(v4)
    )
    return pg.unsafe_hosts(t.events.select(u.alias("host"), address.alias("address")))
