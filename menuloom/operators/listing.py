"""Paged listings and per-entity summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import reliable_checkpoint
from .groups import join_keys

# Page sizes.
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
DEFAULT_PENDING = 100


def page(
    df: DataFrame, order: Sequence[Column], number: int = 1, size: int = DEFAULT_PAGE_SIZE, with_total: bool = False
) -> DataFrame:
    """One page in the given total order. The total is a scalar sub-query over
    the keys alone; the page itself never sorts more than it keeps per task."""
    if number < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError("page numbers start at 1 and sizes are 1 to 100")
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    if with_total:
        rows = rows.withColumn("total", df.agg(F.count(F.lit(1))).scalar())
    return rows


def deep_page(df: DataFrame, order: Sequence[tuple[str, bool]], number: int, size: int = DEFAULT_PAGE_SIZE, parts: int | None = None) -> DataFrame:
    """A page far from the start. ``order`` are (column, descending) that together are unique, with
    ``page``'s place of nulls. Only these columns are dealt out by range; each range is counted,
    and only the ranges in which the page lies are sorted, so no task holds what comes before
    it. The page's keys, ``size`` at most, then fetch their rows. ``parts`` is the number of ranges,
    by default one per shuffle partition."""
    if number < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError("page numbers start at 1 and sizes are 1 to 100")
    names = [c for c, _ in order]
    by = lambda: [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = reliable_checkpoint(df.select(*names).repartitionByRange(parts, *by()).withColumn("_range", F.spark_partition_id()))
    counts = dict(ranged.groupBy("_range").count().collect())  # a number for each range
    first, before, start, wanted = (number - 1) * size, 0, None, []
    for n in sorted(counts):
        if before < first + size and before + counts[n] > first:
            start = before if start is None else start
            wanted.append(n)
        before += counts[n]
    near = ranged.where(F.col("_range").isin(wanted)) if wanted else ranged.limit(0)
    keys = near.orderBy("_range", *by()).offset(max(0, first - (start or 0))).limit(size).drop("_range")
    # At most a page of keys.
    found = F.broadcast(reliable_checkpoint(keys))
    return join_keys(df, found, names, "left_semi").orderBy(*by())


def newest(df: DataFrame, n: int, ts: str = "created_at", key: str = "id") -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def first_by_id(rows: DataFrame, entity: str, value: str, key: str) -> DataFrame:
    """Value of the row with the lowest id per entity."""
    return rows.groupBy(entity).agg(F.min_by(value, key).alias(value))


def dish_counts(
    restaurants: DataFrame, menus: DataFrame, categories: DataFrame, dishes: DataFrame
) -> DataFrame:
    """Dishes per restaurant at all depths, zero when none. Counts are folded at
    every level before the next join, so the dish table is shuffled only as one
    partial count per category."""
    per_category = dishes.groupBy("category_id").agg(F.count(F.lit(1)).alias("_n"))
    per_menu = categories.select("category_id", "menu_id").join(per_category, "category_id").groupBy("menu_id").agg(F.sum("_n").alias("_n"))
    per_restaurant = menus.select("menu_id", "restaurant_id").join(per_menu, "menu_id").groupBy("restaurant_id").agg(F.sum("_n").alias("_n"))
    return restaurants.select("restaurant_id").join(per_restaurant, "restaurant_id", "left").select(
        "restaurant_id", F.coalesce("_n", F.lit(0)).cast("long").alias("menu_item_count")
    )


def restaurant_summary(
    restaurants: DataFrame, locations: DataFrame, dishes: DataFrame, number: int = 1, size: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    """A page of restaurants with first city and dish count. The page is chosen
    first: it has at most 100 rows, so it is broadcast and only its restaurants'
    locations and dishes are aggregated. ``dishes`` carries restaurant_id."""
    chosen = page(restaurants, [F.col("created_at").desc(), F.col("restaurant_id").desc()], number, size)
    wanted = F.broadcast(chosen.select("restaurant_id"))
    city = first_by_id(locations.join(wanted, "restaurant_id", "left_semi"), "restaurant_id", "city", "location_id")
    counts = dishes.join(wanted, "restaurant_id", "left_semi").groupBy("restaurant_id").agg(
        F.count(F.lit(1)).alias("menu_item_count")
    )
    return (
        chosen.join(city, "restaurant_id", "left").join(counts, "restaurant_id", "left")
        .withColumn("menu_item_count", F.coalesce("menu_item_count", F.lit(0)))
        .withColumn("total", restaurants.agg(F.count(F.lit(1))).scalar())
    )
