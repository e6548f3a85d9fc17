"""Summaries of issue rows, and the full rule run over flat tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from . import corrections, rules
from .groups import join_keys, top_of_group

MESSAGES_SHOWN = 5


def split_by_severity(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    return issues.filter(F.col("severity") == rules.ERROR), issues.filter(F.col("severity") == rules.WARNING)


def outcome_per_record(
    records: DataFrame, issues: DataFrame, keys: Sequence[str], log: DataFrame | None = None
) -> DataFrame:
    """Errors, warnings, issue count and validity of every record; a record
    without issues shows zeros; issues of a null key are those of the records without one. Warnings never make a record invalid."""
    keys = list(keys)
    counted = issues.groupBy(*keys).agg(
        F.count_if(F.col("severity") == rules.ERROR).alias("errors"),
        F.count_if(F.col("severity") == rules.WARNING).alias("warnings"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = join_keys(records.select(*keys), counted, keys, "left").select(
        *keys, zero("errors").alias("errors"), zero("warnings").alias("warnings")
    ).withColumn("issue_count", F.col("errors") + F.col("warnings")).withColumn("is_valid", F.col("errors") == 0)
    if log is not None:
        fixes = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("corrected_fields"))
        out = join_keys(out, fixes, keys, "left").withColumn("corrected_fields", zero("corrected_fields"))
    return out


def first_messages(issues: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = MESSAGES_SHOWN) -> DataFrame:
    """First n error messages of each record joined by ``; ``. Each record is
    cut to n rows before the shuffle, so the list never grows beyond n."""
    errors = issues.filter(F.col("severity") == rules.ERROR)
    kept = top_of_group(errors, keys, [F.col(c) for c in order], n)
    listed = F.sort_array(F.collect_list(F.struct(*order, F.col("message").alias("_m"))))
    return kept.groupBy(*keys).agg(
        F.array_join(F.transform(listed, lambda s: s["_m"]), "; ").alias("first_errors")
    )


@dataclass
class Outcome:
    dishes: DataFrame
    issues: DataFrame
    log: DataFrame


def run_rules(
    restaurants: DataFrame,
    locations: DataFrame,
    menus: DataFrame,
    dishes: DataFrame,
    key: str = "restaurant_id",
    dish_key: str = "dish_id",
    scope: Sequence[str] = ("restaurant_id", "menu_pos"),
) -> Outcome:
    """Corrections first, then every rule on the corrected rows. Restaurant
    issues have a null dish key."""
    corrected = corrections.correct_dishes(dishes)
    log = corrections.correction_log(corrected, [key, dish_key])
    fixed = corrections.corrected_only(corrected)
    issues = (
        rules.dish_issues(fixed, [key, dish_key])
        .unionByName(rules.duplicate_issues(fixed, [key, dish_key], list(scope)))
        .unionByName(
            rules.restaurant_issues(restaurants, locations, menus, fixed.select(key), key)
            .withColumn(dish_key, F.lit(None).cast(fixed.schema[dish_key].dataType))
        )
    )
    return Outcome(fixed, issues, log)
