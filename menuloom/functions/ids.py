"""Content hashes and stable ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .let import let

# Fixed value: the URL name space of RFC 4122.
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def uuid5_url(name: Column) -> Column:
    """Name-based UUID (version 5) in the URL name space, JVM-side: SHA-1 of
    name space and name, with the version and variant bits set."""
    return let(F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(name, "UTF-8"))), _as_uuid5)


def _as_uuid5(digest: Column) -> Column:
    variant = F.lower(
        F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80))
    )
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 19, 2), F.lit("-"),
        F.substring(digest, 21, 12),
    )
