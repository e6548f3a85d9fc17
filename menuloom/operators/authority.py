"""Which web address is a restaurant's own: validation, choice, current source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import uuid5_url
from ..functions.let import let
from ..functions.text import confidence_level
from ..functions.urls import canonical_url, domain_of, domain_suffixes, is_ip_literal, with_canonical_url

# Domains that are never a restaurant's own site.
AGGREGATOR_DOMAINS = (
    "yelp.com",
    "tripadvisor.com",
    "opentable.com",
    "zomato.com",
    "foursquare.com",
    "yellowpages.com",
    "doordash.com",
    "ubereats.com",
    "grubhub.com",
    "postmates.com",
    "seamless.com",
    "menufy.com",
    "slicelife.com",
    "chownow.com",
    "toasttab.com",
    "google.com",
    "maps.google.com",
    "bing.com",
    "mapquest.com",
    "facebook.com",
    "instagram.com",
    "twitter.com",
    "x.com",
    "linkedin.com",
    "tiktok.com",
    "linktr.ee",
    "linktree.com",
)


def is_listed_domain(domain: Column, listed: Sequence[str] = AGGREGATOR_DOMAINS) -> Column:
    """Any dotted suffix of at least two labels is on a short fixed list."""
    return F.arrays_overlap(domain_suffixes(domain), F.array(*[F.lit(d) for d in listed]))


def listed_hosts(df: DataFrame, domain: str, blocklist: DataFrame, listed: str = "domain") -> DataFrame:
    """Distinct domains of ``df`` that a blocklist table of any size covers. Only
    distinct domains are expanded to suffixes, so repeated hosts cost nothing."""
    suffixes = df.select(domain).distinct().withColumn("_suffix", F.explode(domain_suffixes(F.col(domain))))
    return suffixes.join(
        blocklist.select(F.lower(listed).alias("_suffix")).distinct(), "_suffix", "left_semi"
    ).select(domain).distinct()


def without_listed(df: DataFrame, domain: str, blocklist: DataFrame, listed: str = "domain") -> DataFrame:
    return df.join(listed_hosts(df, domain, blocklist, listed), domain, "left_anti")


def canonical_group_sizes(urls: DataFrame) -> DataFrame:
    """Rows per canonical URL, which names the group of equivalent raw URLs."""
    return (
        urls.filter(F.col("canonical_url").isNotNull())
        .groupBy("canonical_url")
        .agg(F.count(F.lit(1)).alias("equivalent_rows"))
    )


def validate_official_domain(df: DataFrame, raw: str, listed: Sequence[str] = AGGREGATOR_DOMAINS) -> DataFrame:
    """Canonical URL, domain and the first failing check; accepted when none."""
    def checked(c: Column) -> Column:
        def first_failure(domain: Column) -> Column:
            reason = F.coalesce(
                c["reason"],
                F.when(is_listed_domain(domain, listed), "aggregator"),
                F.when(~F.contains(domain, F.lit(".")), "not_public_domain"),
                F.when(is_ip_literal(domain), "ip_literal"),
                # A second leading "www." would not survive the round trip.
                F.when(F.startswith(domain, F.lit("www.")), "domain_mismatch"),
            )
            return F.struct(c["url"].alias("url"), domain.alias("domain"), reason.alias("reason"))

        return let(domain_of(c["url"]), first_failure)

    return (
        df.withColumn("_o", let(canonical_url(F.col(raw)), checked))
        .withColumn("official_url", F.when(F.col("_o.reason").isNull(), F.col("_o.url")))
        .withColumn("domain", F.col("_o.domain"))
        .withColumn("reject_reason", F.col("_o.reason"))
        .drop("_o")
    )


def choose_candidates(
    candidates: DataFrame, entity: str = "restaurant_id", listed: Sequence[str] = AGGREGATOR_DOMAINS
) -> tuple[DataFrame, DataFrame]:
    """(best surviving candidate per entity, rejected candidates ranked above it).

    Rank is confidence descending, then position. The winner is a map-side
    maximum over the valid rows; the rejected ones are the invalid rows that
    rank above it (all of them when there is no winner)."""
    checked = validate_official_domain(candidates, "url", listed)
    rank = F.struct(F.col("provider_confidence"), (-F.col("pos")).alias("neg_pos"))
    winner = (
        checked.filter(F.col("reject_reason").isNull())
        .groupBy(entity)
        .agg(
            F.max_by(F.struct("official_url", "domain", "provider_confidence", "provider_name"), rank).alias("_w"),
            F.max(rank).alias("_rank"),
        )
        .select(entity, "_w.*", "_rank")
    )
    rejected = (
        checked.filter(F.col("reject_reason").isNotNull())
        .join(winner.select(entity, "_rank"), entity, "left")
        .filter(F.col("_rank").isNull() | (rank > F.col("_rank")))
        .select(entity, "pos", "url", "provider_confidence", "reject_reason")
    )
    return winner.drop("_rank"), rejected


def resolve_sources(
    entities: DataFrame, candidates: DataFrame, entity: str = "restaurant_id",
    listed: Sequence[str] = AGGREGATOR_DOMAINS,
) -> DataFrame:
    """One row per entity: not_found, rejected, needs_review or verified."""
    winner, rejected = choose_candidates(candidates, entity, listed)
    seen = candidates.groupBy(entity).agg(F.count(F.lit(1)).alias("_candidates"))
    refused = rejected.groupBy(entity).agg(F.count(F.lit(1)).alias("rejected_candidates"))
    level = confidence_level(F.col("provider_confidence"))
    status = (
        F.when(F.col("_candidates").isNull(), "not_found")
        .when(F.col("official_url").isNull(), "rejected")
        .when(level == "high", "verified")
        .otherwise("needs_review")
    )
    return (
        entities.select(entity).join(seen, entity, "left").join(winner, entity, "left").join(refused, entity, "left")
        .select(
            entity,
            status.alias("status"),
            level.alias("confidence"),
            F.col("official_url").alias("resolved_url"),
            F.coalesce("rejected_candidates", F.lit(0)).cast("long").alias("rejected_candidates"),
        )
        .withColumn(
            "reason",
            F.when(F.col("status") == "not_found", "no_candidates")
            .when(F.col("status") == "rejected", "all_rejected")
            .when(F.col("status") == "needs_review", "low_confidence"),
        )
    )


def verified_source_rows(resolved: DataFrame, created_at: Column, entity: str = "restaurant_id") -> DataFrame:
    """Rows to append to the sources table; only high confidence is persisted."""
    return resolved.filter(F.col("status") == "verified").select(
        uuid5_url(F.concat(F.lit("source:"), F.col(entity).cast("string"), F.lit(":"), F.col("resolved_url"))).alias("id"),
        F.col(entity),
        F.lit("restaurant_website").alias("source_type"),
        F.col("resolved_url").alias("url"),
        F.lit(True).alias("is_verified_domain"),
        created_at.alias("created_at"),
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Newest row per key, ties by the last order column. ``max_by`` combines
    map-side, so a key with a third of all rows costs no more than others."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_l")).select(*keys, "_l.*")


def latest_verified_website(sources: DataFrame, entity: str = "restaurant_id") -> DataFrame:
    websites = sources.filter((F.col("source_type") == "restaurant_website") & F.col("is_verified_domain"))
    return latest_per_key(websites, [entity], ["created_at", "id"], ["id", "url", "is_verified_domain"])


def latest_snapshot(snapshots: DataFrame, content_type: str | None = None) -> DataFrame:
    if content_type is not None:
        snapshots = snapshots.filter(F.col("content_type") == content_type)
    return latest_per_key(snapshots, ["source_id"], ["fetched_at", "id"], ["id", "content_hash", "fetched_at"])


def current_source(entities: DataFrame, sources: DataFrame, hints: DataFrame, entity: str = "restaurant_id") -> DataFrame:
    """The verified website on record; else the caller's hint if that is verified. Of
    several such hints the first address counts, so an entity stays one row."""
    stored = latest_verified_website(sources, entity).select(entity, F.col("url").alias("_stored"))
    hinted = hints.filter(F.col("is_verified_domain")).groupBy(entity).agg(F.min("url").alias("_hint"))
    return (
        entities.select(entity).join(stored, entity, "left").join(hinted, entity, "left")
        .select(
            entity,
            F.coalesce("_stored", "_hint").alias("url"),
            F.when(F.col("_stored").isNotNull(), "stored").when(F.col("_hint").isNotNull(), "hint").alias("origin"),
        )
    )
