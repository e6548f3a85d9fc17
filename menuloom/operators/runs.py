"""Runs and failed jobs: lifecycle, metrics, dead letters, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ERROR_CHARS, elapsed_ms, retry_at_epoch, truncate

# Marks of a failure worth repeating, and the queues.
TRANSIENT_MARKS = ("ConnectionError", "TimeoutError", "ConnectionRefusedError", "OperationalError")
QUEUES = (
    "restaurant_ingestion",
    "source_crawl",
    "collector_workflow",
    "maintenance_polling",
    "reviewer_workflow",
    "ingestion_queue_dispatch",
)


def looks_transient(error: Column) -> Column:
    return F.coalesce(error.rlike("|".join(TRANSIENT_MARKS)), F.lit(False))


def sweep_failed(jobs: DataFrame) -> DataFrame:
    """Each failed job with what happens to it; a requeued one carries the time
    its next attempt is due."""
    return jobs.withColumn("requeued", looks_transient(F.col("exc_info"))).withColumn(
        "retry_at", F.when(F.col("requeued"), retry_at_epoch(F.col("failed_epoch"), F.col("attempt")))
    )


def sweep_report(swept: DataFrame) -> DataFrame:
    """Requeued and left counts per queue, and the totals in the null row."""
    return swept.rollup("queue").agg(
        F.count_if("requeued").alias("requeued"), F.count_if(~F.col("requeued")).alias("left_for_review")
    )


def merge_metrics(updates: DataFrame) -> DataFrame:
    """Shallow merge per run: a later update's key wins, untouched keys stay. The
    newest value of each (run, key) is a map-side maximum; only one entry per
    distinct key reaches a run's map."""
    entries = updates.select("run_id", "seq", F.explode("metrics").alias("key", "value"))
    newest = entries.groupBy("run_id", "key").agg(F.max_by("value", "seq").alias("value"))
    return newest.groupBy("run_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("metrics")
    )


def run_lifecycle(events: DataFrame) -> DataFrame:
    """Start and end events to one row per run. A run without an end is running;
    the last end counts."""
    ended = F.col("kind").isin("succeeded", "failed")
    per_run = events.groupBy("run_id").agg(
        F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("started_at"),
        F.max_by(F.struct("kind", "ts", "error"), F.when(ended, F.struct("ts", "event_id"))).alias("_end"),
    )
    return per_run.select(
        "run_id",
        F.coalesce("_end.kind", F.lit("running")).alias("status"),
        "started_at",
        F.col("_end.ts").alias("completed_at"),
        elapsed_ms(F.col("started_at"), F.col("_end.ts")).alias("duration_ms"),
        F.when(F.col("_end.kind") == "failed", F.col("_end.error")).alias("error_message"),
        F.when(F.col("_end.kind") == "failed", truncate(F.col("_end.error"), ERROR_CHARS)).alias("error_shown"),
    )


def counters(published: DataFrame, changes: DataFrame, runs: DataFrame) -> DataFrame:
    """The dashboard row: published entities, pending changes, running and failed
    runs; all rows are counted, not one page of them."""
    a = published.agg(F.count(F.lit(1)).alias("n"))
    b = changes.agg(F.count_if(F.col("status") == "pending").alias("n"))
    c = runs.agg(
        F.count_if(F.col("status") == "running").alias("running_runs"),
        F.count_if(F.col("status") == "failed").alias("failed_runs"),
    )
    return c.select(a.scalar().alias("published"), b.scalar().alias("pending_reviews"), "running_runs", "failed_runs")
