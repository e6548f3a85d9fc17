"""URL canonicalisation and host tests as column expressions.

The URL is split once by a generic-syntax pattern; parameters are re-encoded
with higher-order array functions, so no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .let import let
from .text import strip_space

# Parameters that only track a click.
TRACKING_PREFIX = "utm_"
TRACKING_NAMES = ("gclid", "fbclid", "msclkid")
DEFAULT_PORTS = {"https": 443, "http": 80}

GENERIC = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
LAST_SEGMENT = r"(?s)^((?:.*/)?[^/;]*)(?:;([^/]*))?$"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def is_ip_literal(host: Column) -> Column:
    """IPv4 in four plain octets, or anything with a colon (IPv6)."""
    bare = F.regexp_replace(host, r"^[\[\]]+|[\[\]]+$", "")
    return bare.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$") | F.contains(bare, F.lit(":"))


def host_of_authority(authority: Column) -> Column:
    """Lower-case host without user info, port or brackets."""
    return F.lower(
        let(
            _without_user(authority),
            lambda rest: F.when(F.contains(rest, F.lit("[")), F.regexp_extract(rest, r"\[([^\]]*)", 1)).otherwise(
                F.regexp_extract(rest, r"^[^:]*", 0)
            ),
        )
    )


def port_text(authority: Column) -> Column:
    return let(
        _without_user(authority),
        lambda rest: F.when(F.contains(rest, F.lit("[")), F.regexp_extract(rest, r"\]:(.*)$", 1)).otherwise(
            F.regexp_extract(rest, r"(?s):(.*)$", 1)
        ),
    )


def _without_user(authority: Column) -> Column:
    return F.regexp_replace(authority, r"(?s)^.*@", "")


def host_of(url: Column) -> Column:
    """Host of an absolute URL; null when there is none."""
    authority = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.nullif(host_of_authority(authority), F.lit(""))


def domain_of(url: Column) -> Column:
    """Host without one leading ``www.``."""
    return F.regexp_replace(host_of(url), r"^www\.", "")


def domain_suffixes(domain: Column) -> Column:
    """All dotted suffixes that keep at least two labels, longest first."""
    return let(
        F.split(F.lower(domain), r"\."),
        lambda labels: F.when(
            F.size(labels) >= 2,
            F.transform(
                F.sequence(F.lit(1), F.size(labels) - 1),
                lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def _decode(part: Column) -> Column:
    # A percent sign that starts no escape stays as it is.
    return F.url_decode(F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(part: Column) -> Column:
    # The form encoding wanted here keeps "~" and escapes "*"; Java's does the opposite.
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def clean_query(query: Column) -> Column:
    """Drop tracking parameters, keep blanks and order, re-encode the rest."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decode(F.regexp_extract(p, r"(?s)^[^=]*", 0)).alias("k"),
            _decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: ~p["k"].isin(*TRACKING_NAMES)
        & ~F.startswith(F.lower(p["k"]), F.lit(TRACKING_PREFIX)),
    )
    return F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def _split(text: Column) -> Column:
    absolute = F.when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("https://"), text))
    cleaned = F.regexp_replace(absolute, r"^[\x00-\x20]+|[\t\r\n]", "")
    return let(
        cleaned,
        lambda u: F.struct(
            text.alias("text"),
            F.lower(F.regexp_extract(u, GENERIC, 1)).alias("scheme"),
            F.regexp_extract(u, GENERIC, 2).alias("authority"),
            F.regexp_extract(u, GENERIC, 3).alias("tail"),
            F.regexp_extract(u, GENERIC, 4).alias("query"),
        ),
    )


def _parts(split: Column) -> Column:
    return F.struct(
        split["text"].alias("text"),
        split["scheme"].alias("scheme"),
        host_of_authority(split["authority"]).alias("host"),
        port_text(split["authority"]).alias("port"),
        F.regexp_extract(split["tail"], LAST_SEGMENT, 1).alias("path"),
        F.regexp_extract(split["tail"], LAST_SEGMENT, 2).alias("params"),
        clean_query(split["query"]).alias("query"),
    )


def _assembled(p: Column) -> Column:
    port = p["port"].try_cast("int")
    default_port = F.when(p["scheme"] == "https", DEFAULT_PORTS["https"]).otherwise(DEFAULT_PORTS["http"])
    bad_port = (p["port"] != "") & ~(p["port"].rlike("^[0-9]+$") & F.coalesce(port <= 65535, F.lit(False)))
    reason = (
        F.when(F.coalesce(p["text"], F.lit("")) == "", "empty")
        .when(p["host"] == "", "no_hostname")
        .when(~p["scheme"].isin("http", "https"), "unsupported_scheme")
        .when(is_ip_literal(p["host"]), "ip_literal")
        .when(bad_port, "invalid_port")
    )
    path = F.when(p["path"].isin("", "/"), "/").otherwise(F.regexp_replace(p["path"], r"/+$", ""))
    path = F.concat(path, F.when(p["params"] != "", F.concat(F.lit(";"), p["params"])).otherwise(""))
    # Anything after a host starts with a slash.
    path = F.regexp_replace(path, r"^(?=[^/])", "/")
    netloc = F.when((p["port"] == "") | (port == default_port), p["host"]).otherwise(
        F.concat(p["host"], F.lit(":"), port.cast("string"))
    )
    query = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")
    url = F.concat(p["scheme"], F.lit("://"), netloc, path, query)
    return let(reason, lambda r: F.struct(F.when(r.isNull(), url).alias("url"), r.alias("reason")))


def canonical_url(raw: Column) -> Column:
    """struct<url, reason>: the canonical URL, or why there is none."""
    return let(strip_space(raw), lambda text: let(_split(text), lambda s: let(_parts(s), _assembled)))


def with_canonical_url(df: DataFrame, raw: str, url_col: str = "canonical_url", reason_col: str = "reject_reason") -> DataFrame:
    """Add the canonical URL and the reject reason to every row."""
    return (
        df.withColumn("_c", canonical_url(F.col(raw)))
        .withColumn(url_col, F.col("_c.url"))
        .withColumn(reason_col, F.col("_c.reason"))
        .drop("_c")
    )
