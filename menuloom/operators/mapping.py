"""Captured text to extracted rows to catalog rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.ids import uuid5_url
from ..functions.text import SECTION_CHARS, list_or, strip_space, text_or
from ..schema import DEFAULT_CURRENCY, MACROS, MICRONUTRIENTS, MONEY, NUTRIENT, Record
from ..session import reliable_checkpoint
from .conform import conforming, flat_schema_issues
from .groups import join_keys, number_rows

# How documents are joined.
SECTION_SEPARATOR = "\n\n---\n\n"
SECTION_FORMAT = "[snapshot:%s]\n%s"
# Characters of an error message that are kept.
ERROR_CHARS = 2000
# How far from its end a section looks for a place to break.
BREAK_CHARS = 200
# Positions one assembled text covers.
PART_POSITIONS = 1000


def assemble_documents(
    documents: DataFrame, source: str, pos: str, snapshot: str, text: str, part_positions: int = PART_POSITIONS,
    section_chars: int = SECTION_CHARS,
) -> DataFrame:
    """Text of each source, sections in order of ``pos`` (an integer unique per
    source). Nothing is cut off: a text of more than ``section_chars`` characters goes on
    in further sections, its n-th one in the row with ``piece`` n, and a source takes one
    row per ``part_positions`` positions and piece. So a row has at most one section a
    position, and all rows together hold all texts."""
    cut = F.posexplode(sections(F.col(text), section_chars)).alias("piece", "_text")
    pieces = documents.select(source, F.col(pos).alias("_pos"), F.col(snapshot).cast("string").alias("_snapshot"), cut)
    section = F.format_string(SECTION_FORMAT, F.col("_snapshot"), F.col("_text"))
    listed = F.sort_array(F.collect_list(F.struct(F.col("_pos").alias("p"), section.alias("s"))))
    return pieces.groupBy(source, F.floor(F.col("_pos") / part_positions).cast("long").alias("part"), "piece").agg(
        F.array_join(F.transform(listed, lambda x: x["s"]), SECTION_SEPARATOR).alias("content"),
        F.count(F.lit(1)).alias("sections"),
    )


def sections(text: Column, chars: int) -> Column:
    """A text in consecutive sections of at most ``chars`` characters that together are
    the text. A section ends before a line break or an opening tag where there is one among
    its last ``BREAK_CHARS`` characters, so no section is walked back further than that."""
    least = max(1, chars - BREAK_CHARS)
    found = F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{chars}}}(?=\n|<[A-Za-z]|\z)|.{{1,{chars}}}"), F.lit(0))
    return F.when(F.length(text) <= chars, F.array(text)).when(text.isNotNull(), found)


# Answers of one task are handed on together up to this many bytes.
CALL_BYTES = 4 << 20
Call = Callable[[pd.DataFrame], pd.DataFrame]
_ERROR = "_error"


@dataclass
class Extracted:
    """``rows`` conform to the closed schema and are of owners without any failure; ``issues`` are
    violations (keys, field_path, message); ``failures`` are (owner, phase, message), one per failed call."""

    rows: DataFrame
    issues: DataFrame
    failures: DataFrame


def call_each(documents: DataFrame, fn: Call, schema: T.StructType, carry: Sequence[str]) -> DataFrame:
    """Rows (carry, schema, ``_error``) of a function called with each row of ``documents`` as a frame
    of one row. What the call raises, also for rows that do not fit the schema, is one row
    with the message; no document ends the job. Columns of ``carry`` that the schema has too
    are taken from the document. Batches are bounded by bytes; the rows are fixed in the
    shared folder, as the function is costly and need not repeat its answers."""
    kept = [documents.schema[c] for c in carry]
    own = [f for f in schema.fields if f.name not in carry]
    out = T.StructType([*kept, *own, T.StructField(_ERROR, T.StringType())])
    arrow = to_arrow_schema(out)
    fields = to_arrow_schema(T.StructType(own))

    def columns_of(made: pd.DataFrame) -> list[pa.Array]:
        try:
            columns = [pa.array(made[f.name], f.type, from_pandas=True) for f in fields]
            if all(isinstance(c, pa.Array) for c in columns):
                return columns
        except Exception:  # noqa: BLE001  the whole frame is tried again, which says what is wrong with it
            pass
        table = pa.Table.from_pandas(made[fields.names], schema=fields, preserve_index=False)
        return [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns]

    def joined(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        return pa.Table.from_batches(parts, arrow).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                try:
                    columns, error = columns_of(fn(row.to_pandas())), None
                except Exception as e:  # noqa: BLE001  whatever the caller's function raises
                    columns, error = [pa.nulls(1, f.type) for f in fields], f"{type(e).__name__}: {e}"
                n = len(columns[0])
                told = [pa.array(row.column(c).to_pylist() * n, arrow.field(c).type) for c in carry]
                parts.append(pa.RecordBatch.from_arrays([*told, *columns, pa.array([error] * n, pa.string())], schema=arrow))
                size += parts[-1].nbytes
                if size >= CALL_BYTES:
                    yield from joined(parts)
                    parts, size = [], 0
            yield from joined(parts)

    return reliable_checkpoint(documents.mapInArrow(run, out))


def _checked(rows: DataFrame, failures: DataFrame, owner: str, schema: T.StructType, keys: Sequence[str], record: Record) -> Extracted:
    """All or nothing: an owner with a failed call keeps none of its rows."""
    failures = reliable_checkpoint(failures)
    whole = join_keys(rows, failures.select(owner).distinct(), [owner], "left_anti")
    names = [f.name for f in schema.fields if f.name not in keys]
    with_json = whole.withColumn("_json", F.to_json(F.struct(*names)))
    # Every reader of the rows asks for their issues; the schema is checked once.
    issues = reliable_checkpoint(flat_schema_issues(with_json, list(keys), "_json", record))
    return Extracted(conforming(with_json, issues, list(keys)).drop("_json"), issues, failures)


def _failed(rows: DataFrame, owner: str, phase: str) -> DataFrame:
    return rows.filter(F.col(_ERROR).isNotNull()).select(owner, F.lit(phase).alias("phase"), F.left(F.col(_ERROR), F.lit(ERROR_CHARS)).alias("message"))


def extract(documents: DataFrame, fn: Call, schema: T.StructType, keys: Sequence[str], record: Record) -> Extracted:
    """Run a caller's extractor over the assembled documents, one at a time, and check what
    it returns against the closed schema. ``schema`` has the key columns and the record's
    fields; the first key is the owner, which ``documents`` may have or the function gives. Of
    documents in parts and pieces the last key is a position within one of them; it is
    numbered through, so that it is unique again. A call that fails is a row of
    ``failures`` and takes all rows of its owner with it."""
    owner = keys[0]
    if owner not in documents.columns:
        documents = documents.withColumn(owner, F.lit(None).cast(schema[owner].dataType))
        given, carry = True, []
    else:
        given, carry = False, [owner]
    in_parts = {"part", "piece"} <= set(documents.columns)
    rows = call_each(documents, fn, schema, [*carry, *(["part", "piece"] if in_parts else [])])
    failures, rows = _failed(rows, owner, "extraction"), rows.filter(F.col(_ERROR).isNull()).drop(_ERROR)
    if in_parts:
        group, pos = list(keys[:-1]), keys[-1]
        rows = number_rows(rows, group, ["part", "piece", pos], "_no").withColumn(pos, (F.col("_no") - 1).cast(schema[pos].dataType))
        rows = reliable_checkpoint(rows.drop("_no", "part", "piece"))
    if given:
        # The function names the owners, so a failed call has none.
        found = _checked(rows, failures.limit(0), owner, schema, keys, record)
        return Extracted(found.rows, found.issues, reliable_checkpoint(failures))
    return _checked(rows, failures, owner, schema, keys, record)


@dataclass(frozen=True)
class TwoPhase:
    """``discover`` gives the stubs (menu_name, category_name) of a document in their order; ``read`` gets
    the document again with one stub and gives the dishes of that category with their ``pos``."""

    discover: Call
    read: Call


STUBS = T.StructType([T.StructField("menu_name", T.StringType()), T.StructField("category_name", T.StringType())])


def extract_by_category(documents: DataFrame, calls: TwoPhase, schema: T.StructType, keys: Sequence[str], record: Record) -> Extracted:
    """Two phases: the categories of each document, then a call for each category. ``keys`` are the
    owner, ``stub_pos`` and ``pos``. Stubs meet their documents in a join of the small side with the
    texts, so texts are not copied before the calls; the calls of one document may run in
    different tasks only as far as its rows do. Any failed call of an owner, in either
    phase, takes all its rows. A document without categories has no second call."""
    owner, stub_pos = keys[0], keys[1]
    place = [owner, *[c for c in ("part", "piece") if c in documents.columns]]
    discover, ordered = calls.discover, T.StructType([*STUBS.fields, T.StructField("_at", T.IntegerType())])

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        found = discover(pdf)
        return found.assign(_at=range(len(found)))

    listed = call_each(documents, numbered, ordered, place)
    failures, stubs = _failed(listed, owner, "discovery"), listed.filter(F.col(_ERROR).isNull()).drop(_ERROR)
    # An owner that has failed already is not asked further.
    stubs = join_keys(stubs, failures.select(owner).distinct(), [owner], "left_anti")
    through = number_rows(stubs, [owner], [*place[1:], "_at"], stub_pos).drop("_at")
    through = reliable_checkpoint(through.withColumn(stub_pos, (F.col(stub_pos) - 1).cast(schema[stub_pos].dataType)))
    asked = join_keys(documents, through, place)
    read = call_each(asked, calls.read, schema, [owner, stub_pos, *STUBS.fieldNames()])
    failures = failures.unionByName(_failed(read, owner, "category"))
    return _checked(read.filter(F.col(_ERROR).isNull()).drop(_ERROR), failures, owner, schema, keys, record)


def mean_if_all(value: Column) -> Column:
    """Average when every member has a value, else null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def menus_in_first_seen_order(stubs: DataFrame, run: str = "run_id") -> DataFrame:
    """Category stubs with the place of their menu (by first stub) and of the
    category within it, both as sortable positions."""
    firsts = stubs.groupBy(run, "menu_name").agg(F.min("pos").alias("menu_order"))
    return stubs.join(firsts, [run, "menu_name"]).withColumnRenamed("pos", "category_order")


def extraction_metadata(dishes: DataFrame, run: str = "run_id") -> DataFrame:
    """Flat (run, dish, confidence, snapshot) rows."""
    return dishes.select(
        run, "stub_pos", "pos", "name", "confidence", F.explode_outer("source_snapshot_ids").alias("source_snapshot_id")
    )


def map_dishes(
    extracted: DataFrame, category_key: Column, natural_key: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Extracted rows to dish rows: floats to decimals, blank ingredients dropped,
    currency by default USD, ids from the natural key so a re-run repeats them."""

    def decimals(part: str, names: Sequence[str]) -> Column:
        return F.struct(*[F.col(f"nutrition.{part}.{n}").cast(NUTRIENT).alias(n) for n in names]).alias(part)

    ingredients = F.transform(
        F.filter("ingredient_names", lambda n: strip_space(n) != ""),
        lambda n: F.struct(strip_space(n).alias("name"), F.lit(False).alias("is_optional")),
    )
    name = strip_space(F.col("name"))
    return extracted.select(
        uuid5_url(F.concat_ws(":", F.lit("dish"), *[F.col(k).cast("string") for k in natural_key])).alias("id"),
        category_key.alias("category_id"),
        *[k for k in natural_key if k not in ("name",)],
        *keep,
        name.alias("name"),
        "description",
        "image_url",
        F.struct(
            F.col("nutrition.serving_size").alias("serving_size"),
            decimals("macros", MACROS), decimals("micronutrients", MICRONUTRIENTS),
        ).alias("nutrition"),
        F.array_distinct("allergens").alias("allergens"),
        ingredients.alias("ingredients"),
        "quantity",
        F.col("price").cast(MONEY).alias("price"),
        text_or(F.col("currency"), F.lit(DEFAULT_CURRENCY)).alias("currency"),
        F.lit("pending").alias("review_state"),
    )


def merge_profiles(base: DataFrame, profiles: DataFrame, key: str = "restaurant_id") -> DataFrame:
    """Extracted profile over the known restaurant; an empty value never replaces
    a filled one."""
    fields = {"description": text_or, "logo_url": text_or, "cover_image_url": text_or, "cuisine_types": list_or}
    fresh = profiles.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    merged = base.join(fresh, key, "left")
    for f, choose in fields.items():
        merged = merged.withColumn(f, choose(F.col(f"_{f}"), F.col(f)))
    return merged.select(*base.columns)


def merge_menus(current: DataFrame, extracted: DataFrame, key: str = "restaurant_id", keep_current: bool = True) -> DataFrame:
    """Menu rows after extraction. The collector always takes the extracted ones;
    the reviewer keeps an entity's current rows when nothing was extracted."""
    if not keep_current:
        return extracted
    kept = current.join(extracted.select(key).distinct(), key, "left_anti")
    return extracted.unionByName(kept)
