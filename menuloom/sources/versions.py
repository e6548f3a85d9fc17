"""Whole-table versions on plain files: write a new version, then point at it.

Readers follow the newest pointer, which is claimed only after the version is complete, so a
failed or repeated publish is never half visible. Each publisher writes to a folder of its own;
a failed one blocks nobody, and no number has two pointers.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from .commits import CommitConflict, claim, last_version, log_entries, new_folder


def current_version(spark: SparkSession, root: str) -> int | None:
    return last_version(spark, root) or None


def read_version(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    chosen = current_version(spark, root) if version is None else version
    found = log_entries(spark, root).filter(F.col("version") == chosen).first() if chosen else None
    if found is None:
        raise ValueError(f"version {chosen} is not published under {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/{found.folder}/{table}")


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], base: int | None = None) -> int:
    """Write all tables as the next version and make it current. ``base`` is the version that
    the tables were made from (0 for none, by default the current one at the call). If another
    publisher comes first, nothing becomes visible and CommitConflict is raised: tables made
    from an older version would undo the other's changes, so make them anew."""
    seen = last_version(spark, root)
    base = seen if base is None else base
    if seen != base:
        raise CommitConflict(f"made from version {base}, but version {seen} is published under {root}")
    folder = new_folder()
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{root.rstrip('/')}/{folder}/{name}")
    if not claim(spark, root, base + 1, folder):
        raise CommitConflict(f"another publisher made version {base + 1} under {root}")
    return base + 1
