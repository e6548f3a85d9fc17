"""Safe corrections: formatting only. Numbers, prices, allergens and names are
never touched, and every change is logged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.let import let
from ..functions.text import collapse_space, normalize_name

REASONS = {"currency": "upper_case_code", "description": "single_spaces", "ingredients": "repeated_ingredient"}


def correct_currency(c: Column) -> Column:
    return F.when(c.rlike(r"^\p{L}{3}$"), F.upper(c)).otherwise(c)


def correct_description(c: Column) -> Column:
    return collapse_space(c)


def correct_ingredients(c: Column) -> Column:
    """Keep the first of every normalised name, in order."""

    def firsts(names: Column) -> Column:
        return F.filter(c, lambda i, at: F.array_position(names, F.get(names, at)) == at + 1)

    return let(F.transform(c, lambda i: normalize_name(i["name"])), firsts)


def _listing(c: Column) -> Column:
    return F.to_json(F.transform(c, lambda i: i["name"]))


def correct_dishes(dishes: DataFrame) -> DataFrame:
    """Corrected dishes; the untouched originals stay beside them in ``_old``
    until ``correction_log`` or ``corrected_only`` is taken."""
    return (
        dishes.withColumn("_old", F.struct("currency", "description", "ingredients"))
        .withColumn("currency", correct_currency(F.col("currency")))
        .withColumn("description", correct_description(F.col("description")))
        .withColumn("ingredients", correct_ingredients(F.col("ingredients")))
    )


def corrected_only(corrected: DataFrame) -> DataFrame:
    return corrected.drop("_old")


def correction_log(corrected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per applied change: path, old, new, reason."""

    def entry(field: str, old: Column, new: Column, changed: Column) -> Column:
        return F.when(
            changed,
            F.struct(
                F.concat(F.col("path"), F.lit("." + field)).alias("field_path"),
                old.alias("old_value"), new.alias("new_value"), F.lit(REASONS[field]).alias("reason"),
            ),
        )

    def text(field: str) -> Column:
        return entry(field, F.col(f"_old.{field}"), F.col(field), F.col(f"_old.{field}") != F.col(field))

    before, after = F.col("_old.ingredients"), F.col("ingredients")
    entries = F.array(
        text("currency"), text("description"),
        entry("ingredients", _listing(before), _listing(after), F.size(before) != F.size(after)),
    )
    return corrected.select(*keys, F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("_e")).select(*keys, "_e.*")
