import uuid
from urllib.parse import parse_qsl, urlencode

import pytest
from pyspark.sql import functions as F

from menuloom.functions import ids, paths, text, urls
from menuloom.operators import authority, pages

URLS = {
    "example.com": "https://example.com/",
    "HTTPS://Example.COM": "https://example.com/",
    "https://example.com": "https://example.com/",
    "https://example.com/menu/": "https://example.com/menu",
    "https://example.com/": "https://example.com/",
    "https://example.com:443/menu": "https://example.com/menu",
    "http://example.com:80/menu": "http://example.com/menu",
    "https://example.com:8443/menu": "https://example.com:8443/menu",
    "https://example.com:/menu": "https://example.com/menu",
    "https://example.com/menu#section": "https://example.com/menu",
    "https://example.com/?utm_source=google&UTM_medium=cpc": "https://example.com/",
    "https://example.com/?gclid=abc123&fbclid=xyz&msclkid=1": "https://example.com/",
    "https://example.com/?GCLID=1": "https://example.com/?GCLID=1",
    "https://example.com/menu?location=downtown": "https://example.com/menu?location=downtown",
    "https://example.com/?utm_source=x&location=downtown": "https://example.com/?location=downtown",
    "https://u:p@example.com/a;b?x=&y=a+b%2Fc~*&&z": "https://example.com/a;b?x=&y=a+b%2Fc~%2A&z=",
    "\u00a0 example.com/a/b// \x1f": "https://example.com/a/b",
    "https://example.com//": "https://example.com",
    "https://example.com?x=%zz%41": "https://example.com/?x=%25zzA",
}
REJECTED = {
    "": "empty",
    "   ": "empty",
    "ftp://example.com": "unsupported_scheme",
    "https:///path-only": "no_hostname",
    "1a://example.com": "no_hostname",
    "http://169.254.169.254/": "ip_literal",
    "http://[::1]/": "ip_literal",
    "http://example.com:99999/": "invalid_port",
    "http://example.com:x/": "invalid_port",
}


def test_canonical_url(spark):
    rows = spark.createDataFrame([(u,) for u in [*URLS, *REJECTED]], "raw string")
    got = {r.raw: (r.canonical_url, r.reject_reason) for r in urls.with_canonical_url(rows, "raw").collect()}
    assert got == {**{k: (v, None) for k, v in URLS.items()}, **{k: (None, v) for k, v in REJECTED.items()}}


def test_canonical_url_is_stable(spark):
    once = spark.createDataFrame([(u,) for u in URLS.values()], "raw string")
    assert [r.raw for r in urls.with_canonical_url(once, "raw").collect() if r.raw.rstrip("/") != r.canonical_url.rstrip("/")] == []


def test_query_encoding_matches_the_standard_library(spark):
    queries = ["a=1&b=%20+%2B", "x=é&y=%C3%A9", "q=a'b\"c<>", "=v&k", "a=%f0%9f%8d%95", "s=!$()[]{}|^`-_.~*"]
    rows = spark.createDataFrame([(q,) for q in queries], "q string")
    got = [r[0] for r in rows.select(urls.clean_query(F.col("q"))).collect()]
    assert got == [urlencode(parse_qsl(q, keep_blank_values=True)) for q in queries]


def test_uuid5(spark):
    names = ["", "seed:1", "Füße", "x" * 500]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(ids.uuid5_url(F.col("n"))).collect()
    assert [r[0] for r in rows] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_white_space_is_unicode(spark):
    raw = "\u2003 A\u00a0\u0085b\x1c\x1dC \t"
    row = spark.createDataFrame([(raw,)], "t string").select(
        text.collapse_space(F.col("t")), text.normalize_name(F.col("t")), text.strip_space(F.col("t")), text.batch_name_key(F.col("t"))
    ).first()
    assert tuple(row) == (" ".join(raw.split()), " ".join(raw.strip().lower().split()), raw.strip(), raw.strip().lower())


def test_levels_retries_and_fallbacks(spark):
    row = spark.range(1).select(
        *[text.confidence_level(F.lit(v)) for v in (0.75, 0.74, 0.5, 0.49)],
        *[text.retry_at_epoch(F.lit(1000), F.lit(n)) for n in (1, 2, 3)],
        text.text_or(F.lit(""), F.lit("x")), text.text_or(F.lit(None).cast("string"), F.lit("x")),
    ).first()
    assert tuple(row) == ("high", "medium", "medium", "low", 1030, 1120, None, "x", "x")


def test_paths(spark):
    path = "menus[0].categories[1].children[2].dishes[3].nutrition.macros.calories"
    row = spark.range(1).select(
        paths.tokens(F.lit(path)), paths.dish_prefix(F.lit(path)), paths.dish_prefix(F.lit("locations")), paths.top_field(F.lit("cuisine_types[0]")),
        paths.json_value_at(F.lit('{"a": {"b": 5}}'), "a.b"), paths.json_value_at(F.lit('{"a": 1}'), "a.b"),
    ).first()
    assert row[0] == ["menus", "0", "categories", "1", "children", "2", "dishes", "3", "nutrition", "macros", "calories"]
    assert tuple(row)[1:] == ("menus[0].categories[1].children[2].dishes[3]", None, "cuisine_types", "5", None)


DOMAINS = {
    "https://joes-pizza.com/": None,
    "https://www.joes-pizza.com/": None,
    "https://www.yelp.com/biz/joes-pizza": "aggregator",
    "https://order.doordash.com/store/joes-pizza": "aggregator",
    "https://notyelp.com/": None,
    "https://localhost/": "not_public_domain",
    "ftp://joes-pizza.com": "unsupported_scheme",
    "http://169.254.169.254/": "ip_literal",
    "https://www.www.joes.com/": "domain_mismatch",
}


def test_official_domain(spark):
    rows = spark.createDataFrame([(u,) for u in DOMAINS], "url string")
    got = {r.url: r.reject_reason for r in authority.validate_official_domain(rows, "url").collect()}
    assert got == DOMAINS


ADDRESSES = {
    "10.1.2.3": True, "8.8.8.8": False, "172.32.0.1": False, "172.31.255.255": True, "169.254.169.254": True, "127.0.0.1": True,
    "0.0.0.0": True, "224.0.0.1": True, "255.255.255.255": True, "100.64.0.1": False, "192.0.0.9": False, "192.0.0.8": True,
    "::1": True, "::": True, "fe80::1": True, "fd00::1": True, "2606:4700::1111": False, "::ffff:10.0.0.1": True, "::ffff:8.8.8.8": False,
    "2001:db8::1": True, "2002::1": True, "ff02::1": True, "not an address": False, "999.1.1.1": False,
}


def test_unsafe_addresses(spark):
    rows = spark.createDataFrame([(a,) for a in ADDRESSES], "a string")
    got = {r.a: r.u for r in rows.select("a", pages.is_unsafe_address(F.col("a")).alias("u")).collect()}
    assert got == ADDRESSES


@pytest.mark.parametrize("host, expected", [("a.b.co", ["a.b.co", "b.co"]), ("com", []), ("X.Y", ["x.y"])])
def test_suffixes(spark, host, expected):
    assert spark.range(1).select(urls.domain_suffixes(F.lit(host))).first()[0] == expected
