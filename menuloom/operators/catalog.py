"""Changes of a whole catalog: one delta per table, applied in the order of dependence, with
removals that take everything below them.

A catalog is a dict of tables; every row carries its entity. ``LEVELS`` lists the tables, each after
those its rows refer to.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import reliable_checkpoint
from . import delta as deltas
from .groups import join_keys

ENTITY = "entity_id"


@dataclass(frozen=True)
class Ref:
    """A column that holds the ``id`` of a row of ``table``; null refers to nothing."""
    table: str
    column: str


@dataclass(frozen=True)
class Level:
    """``keys`` match rows of two versions (with the entity), ``id`` is what other rows refer to."""
    table: str
    id: str
    keys: tuple[str, ...]
    refs: tuple[Ref, ...] = ()
    fields: tuple[str, ...] | None = None


LEVELS = (
    Level("locations", "location_id", ("location_id",)),
    Level("menus", "menu_id", ("menu_id",)),
    Level("categories", "category_id", ("category_id",), (Ref("menus", "menu_id"), Ref("categories", "parent_id"))),
    Level("dishes", "dish_id", ("dish_id",), (Ref("categories", "category_id"),)),
)


def with_keys(levels: Sequence[Level], table: str, keys: Sequence[str]) -> tuple[Level, ...]:
    """The levels with other keys for one table, such as a natural key."""
    return tuple(replace(x, keys=tuple(keys)) if x.table == table else x for x in levels)


def catalog_diff(current: Mapping[str, DataFrame], target: Mapping[str, DataFrame], levels: Sequence[Level] = LEVELS) -> dict[str, DataFrame]:
    """``table_diff`` of each table both versions have. A category or dish that moves is a change
    of the column that refers to its parent, not a removal and an addition."""
    return {
        x.table: deltas.table_diff(current[x.table], target[x.table], [ENTITY, *x.keys], x.fields)
        for x in levels if x.table in current and x.table in target
    }


def below(rows: DataFrame, id: str, parent: str, start: DataFrame) -> DataFrame:
    """(entity, id) of the rows of ``start`` and of all rows below them. Pointers are doubled: after n
    rounds each row has heard from 2^n ancestors, so a chain of a million takes twenty equality
    joins. A round in which no row is reached ends it: whoever had a start further up would
    have a row between them that is reached now. Cycles end it the same way. Ids are unique per
    entity; only entities with a start are looked at."""
    begun = start.select(ENTITY, F.col(id).alias("_id")).distinct().withColumn("_start", F.lit(True))
    tree = join_keys(rows.select(ENTITY, F.col(id).alias("_id"), F.col(parent).alias("_up")), begun.select(ENTITY).distinct(), [ENTITY], "left_semi")
    state = reliable_checkpoint(
        join_keys(tree, begun, [ENTITY, "_id"], "left").select(ENTITY, "_id", "_up", F.coalesce("_start", F.lit(False)).alias("_hit"))
    )
    reached = state.filter("_hit").count()
    while reached:
        above = state.select(F.col(ENTITY).alias("_e"), F.col("_id").alias("_up_id"), F.col("_up").alias("_next"), F.col("_hit").alias("_above"))
        # A reached row needs no more news, so only others ask.
        asking = state.withColumn("_ask", F.when(~F.col("_hit"), F.col("_up")))
        state = reliable_checkpoint(
            asking.join(above, F.col(ENTITY).eqNullSafe(F.col("_e")) & (F.col("_ask") == F.col("_up_id")), "left")
            .select(ENTITY, "_id", F.col("_next").alias("_up"), (F.col("_hit") | F.coalesce("_above", F.lit(False))).alias("_hit"))
        )
        now = state.filter("_hit").count()
        if now == reached:
            break
        reached = now
    return state.filter("_hit").select(ENTITY, F.col("_id").alias(id))


@dataclass
class Patched:
    tables: dict[str, DataFrame]
    #: (table, entity_id, id) of rows that went because a row above them did.
    cascaded: DataFrame


def apply_catalog_delta(
    live: Mapping[str, DataFrame], target: Mapping[str, DataFrame], delta: Mapping[str, DataFrame], levels: Sequence[Level] = LEVELS,
) -> Patched:
    """The live catalog with the rows that ``delta`` names taken from ``target``, table by table.

    A removal takes what is below it once all moves are made: a category that moves to another
    menu outlives its old one, and what stays goes, at any depth, with its dishes. So does a row that
    is added or moved under a removed one. A reference to a row that never was there takes
    nothing. Tables without a delta lose only what is below a removal. Untouched entities are
    read once and not compared."""
    tables, lost, cascaded = {}, {}, []
    for x in levels:
        if x.table not in live:
            continue
        rows = live[x.table]
        if x.table in delta:
            rows = deltas.patch_rows(rows, target[x.table], delta[x.table], [ENTITY, *x.keys])
        rows = reliable_checkpoint(rows)
        here = [ENTITY, x.id]
        # Ids that the delta takes away: those that were there and are not now.
        gone = live[x.table].limit(0).select(*here)
        if x.table in delta:
            named = delta[x.table].filter(F.col("op") == deltas.REMOVED).select(ENTITY).distinct()
            was = join_keys(live[x.table].select(*here), named, [ENTITY], "left_semi")
            gone = reliable_checkpoint(join_keys(was, rows.select(*here), here, "left_anti"))
        starts = []
        for ref in x.refs:
            missing = gone if ref.table == x.table else lost.get(ref.table)
            if missing is None:
                continue
            up = missing.toDF("_e", "_up")
            starts.append(rows.join(up, F.col(ENTITY).eqNullSafe(F.col("_e")) & (F.col(ref.column) == F.col("_up")), "left_semi").select(*here))
        if starts:
            dead = reduce(DataFrame.union, starts).distinct()
            own = [ref.column for ref in x.refs if ref.table == x.table]
            dead = below(rows, x.id, own[0], dead) if own else reliable_checkpoint(dead)
            rows = join_keys(rows, dead, here, "left_anti")
            cascaded.append(dead.select(F.lit(x.table).alias("table"), ENTITY, F.col(x.id).cast("string").alias("id")))
            gone = gone.union(dead)
        tables[x.table], lost[x.table] = rows, gone
    if not cascaded:
        some = next(iter(live.values()))
        cascaded = [some.limit(0).select(F.lit("").alias("table"), ENTITY, F.lit("").alias("id"))]
    return Patched(tables, reduce(DataFrame.union, cascaded))
