"""Captured content: hash, size, storage key; and reading it back as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ids import sha256_hex, uuid5_url

# File extension per content type.
EXTENSIONS = {"html": "html", "pdf": "pdf", "screenshot": "png"}


def capture(df: DataFrame, source: str, content: str, content_type: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Hash, byte length and storage key of every captured body. The body is
    dropped, so it is never shuffled; write it apart if it must be kept."""
    extension = F.coalesce(*[F.when(content_type == k, v) for k, v in EXTENSIONS.items()])
    digest = sha256_hex(F.col(content).cast("binary"))
    return df.select(
        F.col(source).alias("source_id"),
        *keep,
        content_type.alias("content_type"),
        digest.alias("content_hash"),
        F.octet_length(F.col(content).cast("binary")).cast("long").alias("content_length_bytes"),
        F.concat(F.col(source).cast("string"), F.lit("/"), digest, F.lit("."), extension).alias("storage_path"),
    )


def with_snapshot_id(snapshots: DataFrame) -> DataFrame:
    """An id that a re-run of the same capture repeats."""
    return snapshots.withColumn(
        "id", uuid5_url(F.concat_ws(":", F.lit("snapshot"), "storage_path", F.col("fetched_at").cast("string")))
    )


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    snapshots.withColumn("fetched_on", F.to_date("fetched_at")).hint("rebalance", "fetched_on").write.mode("append").partitionBy("fetched_on").parquet(path)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Stored files as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def as_text(df: DataFrame, content: str, content_type: str = "content_type", out: str = "text") -> DataFrame:
    """UTF-8 text of HTML captures, bad bytes replaced; others carry no text and
    are left out."""
    return df.filter(F.col(content_type) == "html").withColumn(out, F.make_valid_utf8(F.col(content).cast("string")))
