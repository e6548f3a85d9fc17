"""Captured pages: classification, parsing, link discovery, access rules."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.let import let
from ..functions.urls import OCTET, domain_of
from .groups import top_of_group
from .prefixes import first_prefix_rule

# Page size, challenge marks, link words, link limit.
THIN_PAGE_BYTES = 8000
CHALLENGE_STATUS = (403, 503)
CHALLENGE_MARKS = (
    "cf-browser-verification",
    "cf_chl_",
    "Checking your browser before accessing",
    "Attention Required! | Cloudflare",
    "Just a moment...",
)
LINK_WORDS = (
    "menu",
    "menus",
    "food",
    "dishes",
    "order",
    "nutrition",
    "nutritional",
    "allergen",
    "allergens",
    "calorie",
    "calories",
)
LINKS_PER_PAGE = 10


def content_type(header: Column) -> Column:
    return F.when(F.contains(F.lower(header), F.lit("pdf")), "pdf").otherwise("html")


def is_thin_page(kind: Column, body: Column) -> Column:
    return (kind == "html") & (F.octet_length(body) < THIN_PAGE_BYTES)


def is_challenge_page(status: Column, server: Column, mitigated: Column, body: Column) -> Column:
    """``server`` and ``mitigated`` are header values, null when absent."""
    marks = F.lit(False)
    for mark in CHALLENGE_MARKS:
        marks = marks | F.contains(body, F.lit(mark))
    by_header = F.contains(F.lower(F.coalesce(server, F.lit(""))), F.lit("cloudflare")) | mitigated.isNotNull()
    return F.coalesce(status.isin(*CHALLENGE_STATUS) & (by_header | marks), F.lit(False))


def has_link_word(href: Column, text: Column, words: Sequence[str] = LINK_WORDS) -> Column:
    both = F.lower(F.concat_ws("\n", href, text))
    test = F.lit(False)
    for word in words:
        test = test | F.contains(both, F.lit(word))
    return test


def is_inside_domain(url: Column, verified_domain: Column) -> Column:
    """Same host once a leading ``www.`` is gone; a subdomain is outside."""
    bare = F.regexp_replace(F.lower(verified_domain), r"^www\.", "")
    return F.coalesce(domain_of(url) == bare, F.lit(False))


# --- one Arrow pass over the html ----------------------------------------------

class _Page(HTMLParser):
    """Collects head metadata and anchors of one page."""

    HIDDEN = ("script", "style", "template")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] | None = None
        self.meta: dict[str, str | None] = {}
        self.anchors: list[dict] = []
        self._in_title = False
        self._hidden = 0
        self._open: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        attr = {}
        for name, value in attrs:
            attr.setdefault(name, value if value is not None else "")
        if tag in self.HIDDEN:
            self._hidden += 1
        elif tag == "title" and self.title is None:
            self.title, self._in_title = [], True
        elif tag == "meta":
            for by, wanted in (("name", "description"), ("property", "og:title"),
                               ("property", "og:description"), ("property", "og:image")):
                if attr.get(by) == wanted and wanted not in self.meta:
                    content = attr.get("content")
                    self.meta[wanted] = None if content is None else content.strip()
        elif tag == "link" and "canonical" in attr.get("rel", "").split() and "canonical" not in self.meta:
            href = attr.get("href")
            self.meta["canonical"] = None if href is None else href.strip()
        elif tag == "a":
            self._open = None
            if "href" in attr:
                self._open = []
                self.anchors.append({"href": attr["href"], "text": self._open})

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self._hidden = max(self._hidden - 1, 0)
        elif tag == "title":
            self._in_title = False
        elif tag == "a":
            self._open = None

    def handle_data(self, data):
        if self._in_title:
            self.title.append(data.strip())
        elif self._open is not None and not self._hidden:
            self._open.append(data.strip())


PAGE_FIELDS = "title string, description string, canonical_url string, og_title string, og_description string, og_image string"
ANCHOR_FIELDS = "anchors array<struct<pos int, href string, text string, absolute_url string>>"


def _parsed(html: str | None, base: str | None) -> tuple:
    page = _Page()
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError):
        pass  # hopeless markup: keep what was read before it
    anchors = []
    for pos, a in enumerate(page.anchors):
        href = a["href"].strip()
        if href:
            try:
                absolute = urljoin(base or "", href)
            except ValueError:
                absolute = None
            anchors.append({"pos": pos, "href": a["href"], "text": "".join(a["text"]), "absolute_url": absolute})
    meta = page.meta
    return (
        None if page.title is None else "".join(page.title),
        meta.get("description"), meta.get("canonical"), meta.get("og:title"),
        meta.get("og:description"), meta.get("og:image"), anchors,
    )


def parse_pages(pages: DataFrame, keys: Sequence[str], url: str = "url", html: str = "html") -> DataFrame:
    """One pass in Python over each page; the html itself goes no further, only
    its metadata and anchors do, so no later shuffle carries page bodies."""
    names = [f.split()[0] for f in PAGE_FIELDS.split(", ")] + ["anchors"]
    kept = pages.select(*keys, F.col(url).alias("_url"), F.col(html).alias("_html"))
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.select(*keys).schema)}, {PAGE_FIELDS}, {ANCHOR_FIELDS}"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_parsed(h, u) for h, u in zip(pdf["_html"], pdf["_url"])]
            parsed = pd.DataFrame(rows, columns=names, index=pdf.index)
            yield pd.concat([pdf[list(keys)], parsed], axis=1)

    return kept.mapInPandas(parse, out)


def page_metadata(parsed: DataFrame) -> DataFrame:
    return parsed.drop("anchors")


def page_anchors(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parsed.select(*keys, F.explode("anchors").alias("_a")).select(*keys, "_a.*")


def first_links(links: DataFrame, keys: Sequence[str], limit: int = LINKS_PER_PAGE) -> DataFrame:
    """First-seen order, unique by absolute URL, at most ``limit`` per page.
    The limit is the operator's own: pages follow ten links."""
    unique = links.groupBy(*keys, "absolute_url").agg(F.min("pos").alias("pos"))
    return top_of_group(unique, keys, [F.col("pos")], limit)


def discover_links(
    parsed: DataFrame, keys: Sequence[str], domain: str, words: Sequence[str] = LINK_WORDS, limit: int = LINKS_PER_PAGE
) -> DataFrame:
    """Links of each page that name a menu or nutrition page and stay on the
    page's verified domain, kept within the page's row until they are chosen."""
    inside = F.filter(
        F.col("anchors"),
        lambda a: has_link_word(a["href"], a["text"], words) & is_inside_domain(a["absolute_url"], F.col(domain)),
    )
    urls = F.array_distinct(F.transform(inside, lambda a: a["absolute_url"]))
    return parsed.select(*keys, F.posexplode(F.slice(urls, 1, limit)).alias("rank", "absolute_url"))


# --- access rules and addresses -------------------------------------------------

def allowed_by_rules(
    pages: DataFrame, rules: DataFrame, domain: str, path: str, out: str = "allowed", parts: int | None = None
) -> DataFrame:
    """First matching rule (domain, seq, allow, path) of the domain's file decides; no rule or no
    file means allowed, so does a rule without a verdict. A null domain has no rules, and to a
    null path only rules for all paths apply.

    Distinct paths and rules alone are sorted together (``first_prefix_rule``), so neither a
    domain's rules nor its pages are ever in one task or one array; what is found is joined to the
    pages by domain and path. Both sides of that join are split by adaptive execution where
    a path is hot. ``parts`` is the number of chunks."""
    # An empty prefix stands for a rule that forbids nothing; it covers all paths, as a star does.
    prefix = F.col("path")
    known = rules.filter(F.col("domain").isNotNull() & prefix.isNotNull()).select(
        F.col("domain").alias("_group"), F.when(prefix == "*", "").otherwise(prefix).alias("_text"), "seq", "allow",
        prefix.alias("prefix"), F.when(prefix == "", True).otherwise(F.coalesce("allow", F.lit(True))).alias("verdict"),
    )
    text = F.coalesce(F.col(path), F.lit(""))
    wanted = pages.filter(F.col(domain).isNotNull()).select(F.col(domain).alias("_group"), text.alias("_text")).distinct()
    found = first_prefix_rule(wanted, known, parts)
    joined = pages.join(found, (F.col(domain) == F.col("_group")) & (text == F.col("_text")), "left")
    return joined.withColumn(out, F.coalesce("_verdict", F.lit(True))).drop("_group", "_text", "_verdict")


# Addresses no crawl may reach (private, loopback, link-local,
# multicast, reserved, unspecified), and the public blocks inside them.
UNSAFE_RANGES = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
    "::/8",
    "100::/8",
    "200::/7",
    "400::/6",
    "800::/5",
    "1000::/4",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "3fff::/20",
    "4000::/3",
    "6000::/3",
    "8000::/3",
    "a000::/3",
    "c000::/3",
    "e000::/4",
    "f000::/5",
    "f800::/6",
    "fc00::/7",
    "fe00::/9",
    "fe80::/10",
    "ff00::/8",
)
PUBLIC_INSIDE = (
    "192.0.0.9/32",
    "192.0.0.10/32",
    "2001:1::1/128",
    "2001:1::2/128",
    "2001:3::/32",
    "2001:4:112::/48",
    "2001:20::/28",
    "2001:30::/28",
)


def address_key(address: Column) -> Column:
    """Address as lower-case hex of fixed width, 8 digits (v4) or 32 (v6), so
    that text order is numeric order. A v4-mapped v6 address counts as v4."""
    plain = F.regexp_replace(F.lower(address), r"^::ffff:(?=[0-9.]+$)", "")

    def v4(text: Column) -> Column:
        octets = F.split(text, r"\.")
        return F.array_join(F.transform(octets, lambda o: F.lpad(F.lower(F.hex(o.try_cast("int"))), 2, "0")), "")

    def v6(text: Column) -> Column:
        groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
        halves = F.struct(
            groups(F.substring_index(text, "::", 1)).alias("head"),
            groups(F.when(F.contains(text, F.lit("::")), F.substring_index(text, "::", -1)).otherwise("")).alias("tail"),
        )

        def filled(h: Column) -> Column:
            gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(h["head"]) - F.size(h["tail"])))
            return F.array_join(F.transform(F.concat(h["head"], gap, h["tail"]), lambda g: F.lpad(g, 4, "0")), "")

        return let(halves, filled)

    return let(
        plain, lambda p: F.when(F.contains(p, F.lit(":")), v6(p)).when(p.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), v4(p))
    )


def _bounds(cidr: str) -> tuple[str, str]:
    net = ipaddress.ip_network(cidr)
    width = 8 if net.version == 4 else 32
    return f"{int(net.network_address):0{width}x}", f"{int(net.broadcast_address):0{width}x}"


def _in_ranges(key: Column, ranges: Sequence[str]) -> Column:
    test = F.lit(False)
    for lo, hi in map(_bounds, ranges):
        test = test | ((F.length(key) == len(lo)) & key.between(lo, hi))
    return test


def is_unsafe_address(address: Column) -> Column:
    """The ranges are a short fixed list, so they are tested inside the row."""
    return let(
        address_key(address),
        lambda key: F.coalesce(_in_ranges(key, UNSAFE_RANGES) & ~_in_ranges(key, PUBLIC_INSIDE), F.lit(False)),
    )


def unsafe_hosts(resolved: DataFrame, host: str = "host", address: str = "address") -> DataFrame:
    """Unsafe when any address of the host is; combined map-side per host."""
    return resolved.groupBy(host).agg(F.bool_or(is_unsafe_address(F.col(address))).alias("unsafe"))
