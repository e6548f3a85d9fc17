"""Leaf-level differences of nested rows.

A nested value is taken apart into (path, value) rows by one expression made from its type, so
a row is read once, whatever its depth. Items of a list of structs are known by their identity,
not by their place: the path names it, as in ``menus[id=7].dishes[name=Soup].price``. Other
lists are multisets; their elements share the path ``tags[]``. Moving items changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import reliable_checkpoint
from .delta import ADDED, CHANGED, IGNORED_FIELDS, REMOVED
from .groups import join_keys

#: Fields by which list items are known; the first one that the item has counts.
IDENTITY = ("id", "name")
#: JSON of the rows whose leaves one task counts, about; their paths take several times as much.
TASK_CHARS = 16 << 20
FIELD, ELEMENT, ITEM = "field", "element", "item"
_LEAF = "array<struct<path string, owner string, kind string, value string, whole string>>"


def _leaf(path: Column, owner: Column, kind: str, value: Column | None, whole: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        path.alias("path"), owner.alias("owner"), F.lit(kind).alias("kind"),
        (null if value is None else value.cast("string")).alias("value"), (null if whole is None else whole).alias("whole"),
    )


def _named(text: Column) -> Column:
    """An identity as it stands in a path; brackets in it never end the step."""
    return F.coalesce(F.regexp_replace(text.cast("string"), r"([\\\[\]])", r"\\$1"), F.lit("null"))


def leaves(value: Column, kind: T.DataType, path: Column, owner: Column, identity: Sequence[str] = IDENTITY) -> Column:
    """All leaves of a value as an array. ``owner`` is the path of the nearest list item around.
    A null struct has the leaves of one whose fields are null; a null list has none."""
    if isinstance(kind, T.StructType):
        parts = [leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}")), owner, identity) for f in kind.fields]
        return F.concat(*parts) if parts else F.array().cast(_LEAF)
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("id", kind.keyType), T.StructField("value", kind.valueType)])
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("value")))
        return leaves(entries, T.ArrayType(entry), path, owner, ("id",))
    if not isinstance(kind, T.ArrayType):
        return F.array(_leaf(path, owner, FIELD, value))
    inner = kind.elementType
    known = next((n for n in identity if isinstance(inner, T.StructType) and n in inner.fieldNames()), None)
    if known is None:
        nested = isinstance(inner, (T.StructType, T.ArrayType, T.MapType))
        made = F.transform(value, lambda e: _leaf(F.concat(path, F.lit("[]")), owner, ELEMENT, F.to_json(e) if nested else e))
        return F.coalesce(made, F.array().cast(_LEAF))

    def item(e: Column) -> Column:
        at = F.concat(path, F.lit(f"[{known}="), _named(e[known]), F.lit("]"))
        rest = T.StructType([f for f in inner.fields if f.name != known])
        return F.concat(F.array(_leaf(at, owner, ITEM, None, F.to_json(e))), leaves(e, rest, at, at, identity))

    return F.coalesce(F.flatten(F.transform(value, item)), F.array().cast(_LEAF))


def _all_leaves(row: Column, kinds: T.StructType, fields: Sequence[str], identity: Sequence[str]) -> Column:
    return F.concat(*[leaves(row[c] if row is not None else F.col(c), kinds[c].dataType, F.lit(c), F.lit("").cast("string"), identity) for c in fields])


def leaf_rows(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], identity: Sequence[str] = IDENTITY) -> DataFrame:
    """(keys, path, owner, kind, value, whole) of all leaves; no shuffle."""
    return rows.select(*keys, F.explode(_all_leaves(None, rows.schema, fields, identity)).alias("_l")).select(*keys, "_l.*")


def leaf_counts(both: DataFrame, keys: Sequence[str], fields: Sequence[str], identity: Sequence[str] = IDENTITY, tasks: int = 0) -> DataFrame:
    """(keys, path, owner, kind, value, d, n_old, n_new, whole) of the leaves of ``_old`` and ``_new``. Rows are
    dealt by key (to at least ``tasks`` tasks) while they are whole, so leaves are counted where they are taken apart."""
    def side(c: str, sign: int) -> Column:
        return F.transform(_all_leaves(F.col(c), both.schema[c].dataType, fields, identity), lambda e: F.struct(e.alias("l"), F.lit(sign).alias("d")))

    usual = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (both.repartition(tasks, *keys) if tasks > usual else both.repartition(*keys)).select(*keys, F.explode(F.concat(side("_old", -1), side("_new", 1))).alias("_l"))
    return dealt.select(*keys, "_l.l.*", F.col("_l.d").alias("_d")).groupBy(*keys, "path", "owner", "kind", "value").agg(
        F.sum("_d").cast("long").alias("d"), F.count_if(F.col("_d") < 0).alias("n_old"), F.count_if(F.col("_d") > 0).alias("n_new"), F.max("whole").alias("whole"),
    )


def leaf_diff(
    current: DataFrame, target: DataFrame, keys: Sequence[str], fields: Sequence[str] | None = None, identity: Sequence[str] = IDENTITY,
) -> DataFrame:
    """(keys, path, op, old_value, new_value, copies). A row or a list item that one side lacks is
    one line with the whole of it as JSON (a null path for a row); a field gives a line per change;
    elements of other lists give one line per text with the number of copies added or removed.

    Rows that are equal end at the join on the keys; only the leaves of the others are counted
    by (keys, path, text), a difference of multisets. Leaves are not shuffled, but those that differ. Keys may be null and must be unique
    (``delta.repeated_keys``). Items of one identity in one list are compared as multisets too."""
    keys = list(keys)
    chosen = list(fields) if fields is not None else [c for c in current.columns if c not in keys and c not in IGNORED_FIELDS]
    kinds = {f.name: f.dataType for f in current.schema.fields}
    old = current.select(*keys, F.struct(*chosen).alias("_old"))
    new = target.select(*keys, F.struct(*[F.col(c).cast(kinds[c]).alias(c) for c in chosen]).alias("_new"))
    text = lambda c: F.to_json(c)
    # Texts compare what no comparison of types can (maps); the order of lists is looked at below.
    differ = join_keys(old, new, keys, "full_outer").filter(~text(F.col("_old")).eqNullSafe(text(F.col("_new"))))
    length = lambda c: F.coalesce(F.length(text(F.col(c))), F.lit(0))
    fixed = reliable_checkpoint(differ.withColumn("_chars", (length("_old") + length("_new")).cast("long")))
    null = F.lit(None).cast("string")
    one = F.lit(1).cast("long").alias("copies")
    whole = fixed.filter("_old IS NULL OR _new IS NULL").select(
        *keys, null.alias("path"), F.when(F.col("_old").isNull(), ADDED).otherwise(REMOVED).alias("op"),
        text(F.col("_old")).alias("old_value"), text(F.col("_new")).alias("new_value"), one,
    )
    both = fixed.filter("_old IS NOT NULL AND _new IS NOT NULL")
    chars = both.agg(F.sum("_chars")).first()[0] or 0
    counted = leaf_counts(both, keys, chosen, identity, -(-chars // TASK_CHARS))
    changed = reliable_checkpoint(counted.filter("d <> 0"))
    lone = changed.filter((F.col("kind") == ITEM) & ((F.col("n_old") == 0) | (F.col("n_new") == 0)))
    # What stands inside an item that one side lacks is told by the item's own line.
    inside = lone.select(*keys, F.col("path").alias("owner"))
    rest = join_keys(changed, inside, [*keys, "owner"], "left_anti")
    items = rest.filter((F.col("kind") == ITEM) & ((F.col("n_old") == 0) | (F.col("n_new") == 0)))
    gone = F.col("d") < 0
    copies = F.abs("d").alias("copies")
    item_lines = items.select(
        *keys, "path", F.when(gone, REMOVED).otherwise(ADDED).alias("op"), F.when(gone, F.col("whole")).alias("old_value"), F.when(~gone, F.col("whole")).alias("new_value"), copies,
    )
    w = Window.partitionBy(*keys, "path", "owner")
    fields_ = rest.filter(F.col("kind") != ITEM).withColumns({
        "_minus": F.sum(F.greatest(-F.col("d"), F.lit(0))).over(w), "_plus": F.sum(F.greatest(F.col("d"), F.lit(0))).over(w),
        "_was": F.max(F.when(F.col("d") < 0, F.col("value"))).over(w),
    })
    pair = (F.col("kind") == FIELD) & (F.col("_minus") == 1) & (F.col("_plus") == 1)
    field_lines = fields_.filter(~(pair & gone)).select(
        *keys, "path", F.when(pair, CHANGED).when(gone, REMOVED).otherwise(ADDED).alias("op"),
        F.when(pair, F.col("_was")).when(gone, F.col("value")).alias("old_value"), F.when(~gone, F.col("value")).alias("new_value"), copies,
    )
    return whole.unionByName(item_lines).unionByName(field_lines)
