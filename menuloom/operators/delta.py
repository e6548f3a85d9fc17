"""Differences between two versions of a table, their scope, origin and use.

Rows are matched by key columns, by default a natural key, because a fresh
extraction gives every row a new id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import normalize_name
from ..session import broadcast_if_small
from .groups import join_keys, number_rows

# Bookkeeping fields no diff reports, fields a patch may write, and
# profile fields that have a provenance of their own.
IGNORED_FIELDS = ("id", "created_at", "updated_at")
PATCH_FIELDS = ("description", "logo_url", "cover_image_url", "cuisine_types", "website_url", "gallery_image_urls")
PROFILE_FIELDS = ("description", "cuisine_types", "logo_url", "cover_image_url")

ADDED, REMOVED, CHANGED = "added", "removed", "changed"


def with_natural_key(rows: DataFrame, scope: Sequence[str], order: Sequence[str], name: str = "name") -> DataFrame:
    """Add ``name_key`` and ``occurrence``: equal names within a scope are told
    apart by their order."""
    keyed = rows.withColumn("name_key", normalize_name(F.col(name)))
    return number_rows(keyed, [*scope, "name_key"], order, "occurrence")


def _text(c: Column, kind: T.DataType) -> Column:
    nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType))
    return F.to_json(c) if nested else c.cast("string")


def _comparable(c: Column, kind: T.DataType) -> Column:
    """Arrays compare without order."""
    if not isinstance(kind, T.ArrayType):
        return c
    if isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.sort_array(F.transform(c, lambda e: F.to_json(e)))
    return F.sort_array(c)


def table_diff(
    current: DataFrame, target: DataFrame, keys: Sequence[str], fields: Sequence[str] | None = None
) -> DataFrame:
    """(keys, field, op, old_value, new_value). An added or removed row is one
    line with the whole row as JSON and a null field; a changed row gives one line
    per changed field. One full outer join on a unique key (``repeated_keys`` lists those
    that are not), so the shuffle is even; a null key part equals a null one."""
    keys = list(keys)
    chosen = list(fields) if fields is not None else [
        c for c in current.columns if c not in keys and c not in IGNORED_FIELDS
    ]
    kinds = {f.name: f.dataType for f in current.schema.fields}
    old = current.select(*keys, F.struct(*chosen).alias("_old"))
    new = target.select(*keys, F.struct(*[F.col(c).cast(kinds[c]).alias(c) for c in chosen]).alias("_new"))

    def line(field: str | None, op: str, was: Column | None, now: Column | None) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(
            F.lit(field).cast("string").alias("field"), F.lit(op).alias("op"),
            (null if was is None else was).alias("old_value"), (null if now is None else now).alias("new_value"),
        )

    changes = []
    for c in chosen:
        was, now, kind = F.col("_old")[c], F.col("_new")[c], kinds[c]
        differs = ~_comparable(was, kind).eqNullSafe(_comparable(now, kind))
        changes.append(F.when(differs, line(c, CHANGED, _text(was, kind), _text(now, kind))))
    lines = (
        F.when(F.col("_old").isNull(), F.array(line(None, ADDED, None, F.to_json("_new"))))
        .when(F.col("_new").isNull(), F.array(line(None, REMOVED, F.to_json("_old"), None)))
        .otherwise(F.array(*changes))
    )
    exploded = join_keys(old, new, keys, "full_outer").select(*keys, F.explode(lines).alias("_d"))
    return exploded.filter(F.col("_d").isNotNull()).select(*keys, "_d.*")


def repeated_keys(current: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, in_current, in_target) of keys that a side holds more than once. Their rows cannot
    be paired; tell them apart (``with_natural_key``) before a diff. Only keys are shuffled."""
    sides = current.select(*keys, F.lit(True).alias("_old")).unionByName(target.select(*keys, F.lit(False).alias("_old")))
    counted = sides.groupBy(*keys).agg(F.count_if("_old").alias("in_current"), F.count_if(~F.col("_old")).alias("in_target"))
    return counted.filter("in_current > 1 OR in_target > 1")


def touched_keys(delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys the delta adds or changes; a removed row has nothing left to check."""
    return delta.filter(F.col("op").isin(ADDED, CHANGED)).select(*keys).distinct()


def scoped_issues(issues: DataFrame, touched: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Issues of touched rows, and every issue that belongs to no row. Without a
    delta everything is reported."""
    if touched is None:
        return issues
    keys = list(keys)
    owned = join_keys(issues.filter(F.col(keys[-1]).isNotNull()), touched, keys, "left_semi")
    return owned.unionByName(issues.filter(F.col(keys[-1]).isNull()))


def scoped_report(records: DataFrame, issues: DataFrame, touched: DataFrame | None, entity: str, keys: Sequence[str]) -> DataFrame:
    """What is reported is scoped to the change; whether a record is valid is
    judged on all its issues."""
    from .report import outcome_per_record

    full = outcome_per_record(records, issues, [entity])
    shown = scoped_issues(issues, touched, keys).groupBy(entity).agg(F.count(F.lit(1)).alias("reported_issues"))
    return join_keys(full, shown, [entity], "left").withColumn("reported_issues", F.coalesce("reported_issues", F.lit(0)).cast("long"))


def with_provenance(
    delta: DataFrame, row_refs: DataFrame, profile_refs: DataFrame, keys: Sequence[str], entity: str,
    refs: str = "source_snapshot_ids",
) -> DataFrame:
    """Snapshots each change was read from: the row's own, else the profile's for
    the four profile fields, none for a removal. Both tables are unique per key."""
    own = join_keys(delta, row_refs.select(*keys, F.col(refs).alias("_row")), keys, "left")
    joined = join_keys(own, profile_refs.select(entity, F.col(refs).alias("_profile")), [entity], "left")
    none = F.array().cast("array<string>")
    found = (
        F.when(F.col("op") == REMOVED, none)
        .when(F.col("_row").isNotNull(), F.col("_row"))
        .when(F.col("field").isin(*PROFILE_FIELDS), F.coalesce("_profile", none))
        .otherwise(none)
    )
    return joined.withColumn(refs, found).drop("_row", "_profile")


def one_op_per_key(delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Several changes of a row collapse to one; removed beats the others."""
    rank = F.when(F.col("op") == REMOVED, 1).otherwise(0)
    return delta.groupBy(*keys).agg((F.max(rank) == 1).alias("is_removed"))


def patch_rows(current: DataFrame, target: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current rows without the touched ones, plus the touched ones whole from the
    target. The touched keys are fixed and counted; when they fit they are
    broadcast and untouched rows are not shuffled, else both sides are."""
    keys = list(keys)
    ops = broadcast_if_small(one_op_per_key(delta, keys))
    kept = join_keys(current, ops.select(*keys), keys, "left_anti")
    put = join_keys(target, ops.filter(~F.col("is_removed")).select(*keys), keys, "left_semi")
    return kept.unionByName(put)


def patch_fields(
    current: DataFrame, target: DataFrame, delta: DataFrame, keys: Sequence[str], fields: Sequence[str] = PATCH_FIELDS
) -> DataFrame:
    """Scalar fields: only the listed fields that the delta changes are written;
    rows are neither added nor removed."""
    keys, present = list(keys), [f for f in fields if f in current.columns]
    named = delta.filter(F.col("field").isin(*present))
    touched = named.groupBy(*keys).agg(*[F.bool_or(F.col("field") == f).alias(f"_t_{f}") for f in present])
    values = join_keys(target, touched, keys).select(
        *keys, *[f"_t_{f}" for f in present], *[F.col(f).alias(f"_v_{f}") for f in present]
    )
    joined = join_keys(current, values, keys, "left")
    return joined.select(
        *[
            F.when(F.col(f"_t_{c}"), F.col(f"_v_{c}")).otherwise(F.col(c)).alias(c) if c in present else F.col(c)
            for c in current.columns
        ]
    )
