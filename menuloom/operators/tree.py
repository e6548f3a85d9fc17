"""Nested trees kept as flat tables: paths, nesting for export, shredding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import broadcast_if_small, reliable_checkpoint
from .groups import hot_limit, join_keys, number_rows, split_hot, totals_before

# The most children one exported array holds; further ones go to further rows.
PART_ROWS = 10_000


def category_paths(
    nodes: DataFrame, node: str, parent: str, label: Column, separator: str = "."
) -> tuple[DataFrame, DataFrame]:
    """(path of every node from its root, nodes on or below a cycle or a missing
    parent). Pointers are doubled, so depth d takes log2(d) rounds, and only nodes without
    a root yet take part in a round. After k rounds these are the nodes deeper than
    2^k and those that never reach a root; so when a round resolves none, none ever will."""
    reach = nodes.select(node, F.col(parent).alias("_up"), label.cast("string").alias("path"), F.lit(1).alias("depth"))
    reach = reliable_checkpoint(reach.withColumn("_open", F.col("_up").isNotNull()))
    left = reach.where("_open").count()
    while left:
        done, active = reach.where("NOT _open"), reach.where("_open")
        upper = reach.select(
            F.col(node).alias("_up"), F.col("_up").alias("_next"), F.col("path").alias("_prefix"), F.col("depth").alias("_more"),
        )
        # A parent that is not in the table closes the node; it keeps its pointer.
        moved = active.join(upper, "_up", "left").select(
            node,
            F.when(F.col("_prefix").isNull(), F.col("_up")).otherwise(F.col("_next")).alias("_up"),
            F.when(F.col("_prefix").isNull(), F.col("path")).otherwise(F.concat("_prefix", F.lit(separator), "path")).alias("path"),
            (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"),
            (F.col("_prefix").isNotNull() & F.col("_next").isNotNull()).alias("_open"),
        )
        reach = reliable_checkpoint(done.unionByName(moved))
        still = reach.where("_open").count()
        if still == left:
            break
        left = still
    return (
        reach.filter(F.col("_up").isNull()).select(node, "path", "depth"),
        reach.filter(F.col("_up").isNotNull()).select(node, F.col("_up").alias("unresolved_parent")),
    )


def nest(
    parents: DataFrame, children: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], out: str,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Parents with their children as an ordered array. ``order`` is the child's
    integer position, unique within its parent, so every array holds at most
    ``part_rows`` children; a larger parent takes several rows, numbered by
    ``<out>_part``, and its arrays joined in part order are the whole."""
    part = f"{out}_part"
    arrays = children.groupBy(*keys, F.floor(F.col(order) / part_rows).cast("long").alias(part)).agg(
        F.sort_array(F.collect_list(F.struct(order, *fields))).alias(out)
    )
    empty = F.array().cast(arrays.schema[out].dataType)
    return (
        parents.join(arrays, list(keys), "left")
        .withColumn(out, F.coalesce(out, empty))
        .withColumn(part, F.coalesce(part, F.lit(0).cast("long")))
    )


def assemble(
    restaurants: DataFrame, locations: DataFrame, menus: DataFrame, categories: DataFrame, dishes: DataFrame,
    part_rows: int = PART_ROWS,
) -> dict[str, DataFrame]:
    """Flat tables to the rows of two exports that are never joined to each other:
    ``menus`` has per restaurant its menus, categories and dishes, ``locations`` its
    locations. Both are numbered in parts.

    Every menu, category and dish is one entry, in document order, and a part is
    ``part_rows`` entries in a row, so a row's size is bounded by its entries, not by level.
    A category or menu that goes on in the next part is named there again by its
    keys alone; its further columns stand where it begins, so nothing is listed twice.
    Categories stay a flat list under their menu with ``parent_id`` (a row type cannot
    contain itself); roots have a null parent."""
    menu = menus.select("menu_id", "restaurant_id", F.col("pos").cast("long").alias("menu_pos"), _rest(menus, "menu_id", "restaurant_id", "pos").alias("menu"))
    category = categories.select("category_id", "menu_id", F.col("pos").cast("long").alias("category_pos"), "parent_id", _rest(categories, "category_id", "menu_id", "parent_id", "pos").alias("category"))
    dish = dishes.select("category_id", F.col("pos").cast("long").alias("dish_pos"), _rest(dishes, "category_id", "pos").alias("dish"))
    # Depth first: a menu (-1, -1), its categories (pos, -1), their dishes (pos, pos), nulls first. Numbers come from
    # sizes: how many entries are before a menu, before a category within its menu, before a dish within
    # its category. So dishes are dealt twice only, to their category and, listed, to their part.
    early = lambda pos: F.col(pos).isNull() | (F.col(pos) < -1)
    none = lambda *names: {n: F.coalesce(n, F.lit(0)) for n in names}
    sizes = dish.groupBy("category_id").agg(F.count(F.lit(1)).alias("size"), F.count_if(early("dish_pos")).alias("low"))
    sized = category.join(sizes, "category_id", "left").withColumns(none("size", "low")).withColumn("size", F.col("size") + 1)
    # Dishes of no category are among those of no menu; only their number matters.
    held = reliable_checkpoint(category.withColumn("first", F.lit(1)).join(sizes, "category_id", "full_outer").groupBy("menu_id").agg(
        F.sum(F.coalesce("size", F.lit(0)) + 1).alias("held"), F.sum(F.when(early("category_pos"), F.coalesce("size", F.lit(0)) + 1).otherwise(0)).alias("early"),
        F.count("first").alias("categories"), F.max("size").alias("dishes"),
    ))
    most_categories, most_dishes = (x or 0 for x in held.agg(F.max(F.when(F.col("menu_id").isNotNull(), F.col("categories"))), F.max("dishes")).first())
    menu_keys = ["restaurant_id", "menu_pos", "menu_id"]
    places = menu.groupBy(*menu_keys).agg(F.count(F.lit(1)).alias("copies")).join(held.drop("categories", "dishes"), "menu_id", "left").withColumns(none("held", "early"))
    places = places.withColumn("entries", F.col("copies") * (F.col("held") + 1))
    places = totals_before(places, ["restaurant_id"], ["menu_pos", "menu_id"], "entries", "start").drop("held", "entries")
    of_category = _first_numbers(totals_before(
        sized.join(places, "menu_id"), menu_keys, ["category_pos", "category_id", "parent_id", "category"], "size", "before", most_categories
    ), menu_keys)
    parted = lambda no: F.floor((no - 1) / part_rows).cast("long")
    in_category = _listed_dishes(of_category, dish.where(F.col("category_id").isNotNull()), menu_keys, parted, most_dishes)
    # What stands at no position is counted, but not listed.
    in_category = in_category.where(F.col("category_pos").isNotNull()).withColumn("category_id", F.when(F.col("category_pos") >= 0, F.col("category_id")))
    in_menu = join_keys(number_rows(menu, menu_keys, ["menu"], "copy"), places, menu_keys).select(
        *menu_keys, "menu", parted(F.col("start") + F.col("copies") * F.col("early") + F.col("copy")).alias("part")
    )
    in_menu = in_menu.unionByName(in_category, allowMissingColumns=True).repartition("restaurant_id", "part").groupBy("restaurant_id", "part", "menu_pos", "menu_id").agg(
        F.first("menu", ignorenulls=True).alias("menu"),
        _listed(F.col("category_id").isNotNull(), F.col("category_pos").alias("pos"), "category_id", "parent_id", "category", "dishes").alias("categories"),
    )
    rows = in_menu.groupBy("restaurant_id", "part").agg(
        F.sort_array(F.collect_list(F.struct(F.col("menu_pos").alias("pos"), "menu_id", "menu", "categories"))).alias("menus")
    )
    return {
        "restaurants": restaurants,
        "menus": rows,
        "locations": nest(restaurants.select("restaurant_id"), locations, ["restaurant_id"], "pos", [c for c in locations.columns if c not in ("restaurant_id", "pos")], "locations", part_rows).where(F.size("locations") > 0),
    }


def _listed(test: Column, *fields: Column | str) -> Column:
    return F.sort_array(F.collect_list(F.when(test, F.struct(*fields))))


def _first_numbers(rows: DataFrame, menu_keys: Sequence[str]) -> DataFrame:
    """Each category as often as its menu is there, with ``base`` and ``step``: its dish n has the number
    base + (n - 1) * step in its restaurant, and further ``step`` behind the category's own entry. Equal
    categories of a menu stand side by side, and so do their dishes."""
    same = Window.partitionBy(*menu_keys, "category_pos", "category_id")
    nth = F.row_number().over(same.orderBy("parent_id", "category")) - 1
    rows = rows.withColumns({"nth": nth, "step": F.count(F.lit(1)).over(same) * F.col("copies")}).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    behind_menu = F.when(F.col("category_pos") >= -1, F.col("copies")).otherwise(0)
    before = F.col("start") + F.col("copies") * (F.col("before") - F.col("nth") * F.col("size")) + behind_menu
    return rows.select(
        *menu_keys, "category_pos", "category_id", "parent_id", "category", "step", "low",
        (before + F.col("nth") * F.col("copies") + F.col("copy")).alias("base"),
    )


def _listed_dishes(categories: DataFrame, dishes: DataFrame, menu_keys: Sequence[str], parted: Callable[[Column], Column], largest: int) -> DataFrame:
    """One row per category and part in which it or dishes of it are, with its dishes there as an array. Dishes meet their
    category, are numbered and listed in one task; those of a hot category stay where they are and
    are dealt by part."""
    keys, order = ["restaurant_id", "part", *[k for k in menu_keys if k != "restaurant_id"], "category_pos", "category_id"], ["dish_pos", "dish"]
    own = F.struct(parted(F.col("base") + F.col("step") * F.col("low")).alias("part"), F.lit(True).alias("begins"))
    dish_no = F.col("base") + (F.col("no") - 1) * F.col("step") + F.when(F.col("dish_pos") >= -1, F.col("step")).otherwise(0)
    of_dish = F.struct(parted(dish_no).alias("part"), F.lit(False).alias("begins"))

    def listed(joined: DataFrame, entries: Column) -> DataFrame:
        return joined.withColumn("_entry", F.explode(entries)).withColumns({"part": F.col("_entry.part"), "begins": F.col("_entry.begins")}).groupBy(*keys).agg(
            F.first("parent_id").alias("parent_id"), F.first(F.when(F.col("begins"), F.col("category")), ignorenulls=True).alias("category"),
            _listed(~F.col("begins") & (F.col("dish_pos") >= 0), F.col("dish_pos").alias("pos"), "dish").alias("dishes"),
        )

    cold, hot = split_hot(dishes, ["category_id"]) if largest > hot_limit(dishes) else (dishes, None)
    numbered = cold.withColumn("no", F.row_number().over(Window.partitionBy("category_id").orderBy(*order)))
    every = F.when(F.col("no").isNull(), F.array(own)).when(F.col("no") == 1, F.array(own, of_dish)).otherwise(F.array(of_dish))
    out = listed(categories.join(numbered, "category_id", "left"), every)
    if hot is None:
        return out
    few = broadcast_if_small(categories.join(reliable_checkpoint(hot.select("category_id").distinct()), "category_id", "left_semi"))
    out = out.unionByName(listed(number_rows(hot, ["category_id"], order, "no").join(few, "category_id"), F.array(of_dish)))
    return out.groupBy(*keys).agg(
        F.first("parent_id").alias("parent_id"), F.first("category", ignorenulls=True).alias("category"),
        F.sort_array(F.flatten(F.collect_list("dishes"))).alias("dishes"),
    )


def _rest(table: DataFrame, *known: str) -> Column:
    """The further columns as one value; it is never null, so it marks where a record begins."""
    return F.struct(F.lit(True).alias("first"), *[c for c in table.columns if c not in known])


def shred(nested: DataFrame, keys: Sequence[str], array: str) -> DataFrame:
    """One level of a nested array back to rows with their parent's keys."""
    return nested.select(*keys, F.inline(array))


def shred_all(exports: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The flat tables of ``assemble``'s exports, whatever the parts and positions."""
    menus = exports["menus"].select("restaurant_id", F.inline("menus"))
    categories = menus.select("menu_id", F.inline("categories"))
    dishes = categories.select("category_id", F.inline("dishes"))
    flat = lambda df, name: df.where(F.col(name).isNotNull()).select(*[c for c in df.columns if c not in (name, "categories", "dishes")], f"{name}.*").drop("first")
    return {
        "restaurants": exports["restaurants"],
        "locations": exports["locations"].select("restaurant_id", F.inline("locations")),
        "menus": flat(menus, "menu"),
        "categories": flat(categories, "category"),
        "dishes": flat(dishes, "dish"),
    }


def top_level_dish_count(menus: str = "menus") -> Column:
    """Dishes in top-level categories only, folded inside the row."""
    return F.aggregate(
        F.col(menus), F.lit(0),
        lambda n, m: n + F.aggregate(
            F.filter(m["categories"], lambda c: c["parent_id"].isNull()), F.lit(0),
            lambda k, c: k + F.size(c["dishes"]),
        ),
    )
