"""Text helpers: whitespace, names, truncation, falsy-coalesce, levels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character that counts as white space, as a Java pattern.
# (?U)\s covers all but the four separators U+001C to U+001F.
SPACE_CLASS = r"[\s\x1c-\x1f]"
SPACE_RUN = rf"(?U){SPACE_CLASS}+"

# Text limits, confidence levels, retry waits in seconds.
ERROR_CHARS = 2000
SECTION_CHARS = 20_000
HIGH_CONFIDENCE = 0.75
MEDIUM_CONFIDENCE = 0.5
RETRY_WAITS = (30, 120)


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def collapse_space(c: Column) -> Column:
    """Every run of white space becomes one space; none at either end."""
    return F.trim(F.regexp_replace(c, SPACE_RUN, " "))


def normalize_name(c: Column) -> Column:
    return F.lower(collapse_space(c))


def batch_name_key(c: Column) -> Column:
    """Upload key: trimmed and lower-cased, inner spaces kept."""
    return F.lower(strip_space(c))


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def text_or(first: Column, other: Column) -> Column:
    """First non-empty text."""
    return F.when(F.length(first) > 0, first).otherwise(other)


def list_or(first: Column, other: Column) -> Column:
    """First non-empty array."""
    return F.when(F.size(first) > 0, first).otherwise(other)


def confidence_level(c: Column) -> Column:
    return (
        F.when(c >= HIGH_CONFIDENCE, "high")
        .when(c >= MEDIUM_CONFIDENCE, "medium")
        .when(c.isNotNull(), "low")
    )


def retry_at_epoch(failed_epoch: Column, attempt: Column) -> Column:
    """When the next attempt is due; null once all attempts are used."""
    waits = F.array(*[F.lit(w) for w in RETRY_WAITS])
    return failed_epoch + F.try_element_at(waits, attempt)


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1000.0), 2)
