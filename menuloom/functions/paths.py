"""Dotted paths such as ``menus[0].categories[1].dishes[2].price``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DISH_PREFIX = r"^(menus\[\d+\]\.categories\[\d+\](?:\.(?:children|categories)\[\d+\])*\.dishes\[\d+\])"


def tokens(path: Column) -> Column:
    return F.filter(F.split(path, r"[.\[\]]+"), lambda t: t != "")


def top_field(path: Column) -> Column:
    return F.regexp_extract(path, r"^[^.\[]*", 0)


def dish_prefix(path: Column) -> Column:
    """The dish a path belongs to; null for a path outside any dish."""
    found = F.regexp_extract(path, DISH_PREFIX, 1)
    return F.when(found != "", found)


def json_value_at(json: Column, path: str) -> Column:
    """Text of the value at a dotted path; null when any step is missing."""
    return F.get_json_object(json, "$." + path)
