"""Bulk uploads: JSON arrays of items, from files or from request bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.conform import flat_schema_issues
from ..operators.groups import join_keys
from ..schema import UPLOAD_ITEM, UPLOAD_RECORD


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Upload files, one JSON document each: (batch_id, body). One upload is one
    request and is bounded by it; any number of files is read in parallel."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("batch_id"), F.col("value").alias("body")
    )


def upload_items(uploads: DataFrame, batch: str = "batch_id", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(typed items with their position, errors). A body that is no array, or an
    empty one, is an error; so is every field that breaks the item's schema, and
    an item with an error is left out."""
    parsed = uploads.withColumn("_doc", F.try_parse_json(body)).withColumn(
        "_items", F.try_variant_get("_doc", "$", "array<variant>")
    )
    is_array = F.startswith(F.coalesce(F.schema_of_variant("_doc"), F.lit("")), F.lit("ARRAY"))
    refused = parsed.withColumn(
        "message",
        F.when(~is_array, "Input should be a valid list").when(F.size("_items") == 0, "List should have at least 1 item"),
    ).filter(F.col("message").isNotNull()).select(
        batch, F.lit(-1).alias("pos"), F.lit("items").alias("field_path"), "message"
    )
    items = parsed.filter(is_array).select(batch, F.posexplode("_items").alias("pos", "_v")).select(
        batch, "pos", F.to_json("_v").alias("_json")
    )
    issues = flat_schema_issues(items, [batch, "pos"], "_json", UPLOAD_RECORD).select(batch, "pos", "field_path", "message")
    good = join_keys(items, issues.select(batch, "pos").distinct(), [batch, "pos"], "left_anti")
    typed = good.withColumn("_i", F.from_json("_json", UPLOAD_ITEM)).select(batch, "pos", "_i.*")
    return typed, refused.unionByName(issues)


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """Typed rows of JSON files that hold one array (or one object per line)."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(*columns) if columns else rows
